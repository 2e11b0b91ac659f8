"""Content-defined chunks and the pairing of neighbours."""

import hashlib
import random

import pytest

from srcloom.llm import fingerprints as fp
from srcloom.llm.common import table


def plain_boundaries(data):
    value, values = 0, []
    for b in data:
        value = ((value << 1) + int(fp.GEAR[b])) % (1 << 32)
        values.append(value)
    ends, start = [], 0
    while start < len(data):
        end = min(start + fp.MOST, len(data))
        for p in range(start + fp.LEAST, end + 1):
            if values[p - 1] >> (32 - (fp.HARD if p < start + fp.NORMAL else fp.EASY)) == 0:
                end = p
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 100, 5000])
def test_boundaries(size):
    rng = random.Random(size)
    data = bytes(rng.randrange(97, 123) for _ in range(size))
    assert fp.boundaries(data) == plain_boundaries(data)


def test_insertion_moves_few_boundaries():
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    moved = text[:9000] + "inserted words" + text[9000:]
    assert fp.containment(fp.chunk_set(text), fp.chunk_set(moved)) > 0.97
    assert fp.read_in(fp.written_out(fp.chunk_set(text))) == fp.chunk_set(text)


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    found = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        sets = [fp.chunk_set(t) for t in (text, changed, following)]
        found.append(
            (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.written_out(sets[0]), fp.written_out(sets[1]),
             fp.containment(sets[0], sets[1]), fp.containment(sets[0], sets[2]))
        )
    return sorted(found, key=repr)


RNG = random.Random(2)
TABLES = [
    [],
    [(1, None)],
    [(1, "abc" * 50)],
    [(1, "abc" * 50), (1, "abc" * 50), (1, "b"), (None, "x y z" * 30), (None, None), (5, ""), (7, "é" * 100)],
    [(RNG.randint(0, 300), "".join(RNG.choice("abcdef gh") for _ in range(RNG.randint(0, 400)))) for _ in range(400)],
    [(1, "long text " * 50_000), (2, "short")],
]


@pytest.mark.parametrize("rows", TABLES, ids=range(len(TABLES)))
def test_pairs(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")
    assert sorted(map(tuple, fp.with_next(docs).collect()), key=repr) == plain(rows)


def test_query_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    assert sorted(map(tuple, fp.with_next(docs).collect()), key=repr) == plain([tuple(r) for r in docs.collect()])
