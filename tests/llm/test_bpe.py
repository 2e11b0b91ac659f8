"""Segment-tree BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from srcloom.llm import bpe
from srcloom.llm.common import table
from srcloom.llm.queries import QUERIES, WORD_BPE

SF_DIR = "/root/testdata/sf0.001"
PATH = bpe.tokenizer_path(WORD_BPE)
OWN = bpe.read_vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)

FIXED = [
    "", "  ", "hello WORLD's don't 123 45", "x<|endoftext|>y <|startoftext|><|endoftext|> z<|endoftext", "ΑΣ ΣΑΣ σας",
    "İstanbul ǅ ﬁ é e\u0301", "a" * 5000, "ab" * 3000 + "!" * 700, "日本語テスト 😀😀👩‍👩‍👧", "a\x1cb\x1db\x85c\xa0d e\u200bf\x00g\ufeffh",
    "½²³ ⅷ ०१२", "'S 'T 'RE '’s",
]


def same(texts):
    ours = [np.frombuffer(i, "<u4").tolist() for i in bpe.encode_texts(OWN, texts)]
    theirs = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert ours == theirs
    for ids in theirs:
        assert bpe.decode_ids(OWN, np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_fixed_texts():
    same(FIXED)


@given(st.lists(st.text(alphabet="abcdefghXYZÉéß 0123'.,!?-_\n\t日本Σσ\u0301İſ\u3000<|endoftext|>", max_size=60), max_size=20))
@settings(max_examples=100, deadline=None)
def test_random_texts(texts):
    same(texts)


def test_one_piece_and_many_pieces_merge_alike():
    rng = random.Random(5)
    pieces = ["".join(rng.choice("thenaréio") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for piece, ids in zip(pieces, bpe.encode_pieces(OWN, pieces)):
        data = np.frombuffer(piece.encode(), np.uint8)
        symbols = OWN.single[data]
        symbols[-1] = OWN.final[data[-1]]
        assert bpe.merge_all(OWN, symbols.tolist()) == np.frombuffer(ids, "<u4").tolist()


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    same(["one two three four five six", "seven eight one two", *FIXED])


def test_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_bpe"](spark, SF_DIR).collect()}
    docs = table(spark, SF_DIR, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "two words", 3), (1, "two words", 3), (2, "long " * 100_000, 4)],
        "doc_id long, text string, IDS int",
    )
    rows = bpe.with_decoded(bpe.with_ids(docs, OWN, docs.columns), OWN, ["doc_id", "ids"]).collect()
    assert [len(r.ids) // 4 for r in rows] == [0, 0, 2, 2, 100_000]
    assert [r.decoded for r in rows[:4]] == ["", "", "two</w> words</w>", "two</w> words</w>"]
    assert bpe.with_ids(docs.limit(0), OWN, ["doc_id"]).count() == 0


@pytest.mark.parametrize("text", ["a\\b", "\x00", "\x7f"])
def test_control_characters(text):
    same([text])
