"""Chat formatting: exact round trip, shared turns once, attention spans."""

import random

import pytest

from compare import compare, connect
from srcloom.llm import chat
from srcloom.llm.queries import ORACLES, QUERIES

PARTS = ["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "a", "é", "assistant", "<\\|"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = []
    for c in range(200):
        turns = list(rng.choice([[("user", "x"), ("assistant", "<")], [("user", "")], []]))
        for _ in range(rng.randint(0 if turns else 1, 3)):
            role = rng.choice(["assistant", "user", "sys\ntem\\n", "", "<|"])
            turns.append((role, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))))
        made += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return made


@pytest.mark.parametrize("chars,conversations", [(1 << 18, 4096), (60, 4096), (500, 3)])
def test_round_trip(spark, rows, chars, conversations):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_chats(table, chars, conversations)
    found = {r.conv_id: r for r in chat.read_back(packs).collect()}
    expected = {}
    for c, _, role, text in rows:
        expected.setdefault(c, []).append((role, text))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in found.items()} == expected
    for c, r in found.items():
        assert "".join(r.learned) == "".join(t for role, t in expected[c] if role == "assistant")


def test_shared_turns_are_written_once(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (pack,) = chat.format_chats(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    turns = {}
    for c, _, role, text in rows:
        turns.setdefault(c, []).append((role, text))
    prefixes = {tuple(t[:k]) for t in turns.values() for k in range(1, len(t) + 1)}
    assert len(pack.nodes) == len(prefixes)
    assert [n.start for n in pack.nodes] == [0, *[n.stop for n in pack.nodes]][:-1]
    for n in pack.nodes:
        assert sum(s.stop - s.start for s in n.sees) == n.position
        assert all(a.stop < b.start for a, b in zip(n.sees, n.sees[1:]))
        assert all(s.stop <= n.start for s in n.sees)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a", 1), (1, None, None, None, 1), (1, 0, "user", "q", 1), (1, 0, "user", "q", 1), (2, 5, "assistant", "x" * 300_000, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, nodes int")
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(table)).collect()}
    assert found == {None: [("user", "a")], 1: [("", ""), ("user", "q"), ("user", "q")], 2: [("assistant", "x" * 300_000)]}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), QUERIES["op4_chat"], ORACLES["op4_chat"], sf_dir) == []
