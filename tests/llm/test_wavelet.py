"""Wavelet-matrix shards: access, rank, select, exact round trip of token ids."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from srcloom.llm import bpe, wavelet
from srcloom.llm.common import table
from srcloom.llm.queries import BYTE_BPE, QUERIES

PATH = bpe.tokenizer_path(BYTE_BPE)
with open(PATH, encoding="utf-8") as _file:
    STORED = _file.read()
LIBRARY = Tokenizer.from_str(STORED)


def test_encode():
    rng = random.Random(3)
    letters = " \n\t  abcdefgABC'sté123.,!\u2003\u3000\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["a<|endoftext|> b", "\n <|endoftext|>", "a  b   c", "x\n \ny", "", "a  ", " ", "  ", "é é\u3000 a", "a 's 's"]
    for text, ids in zip(texts, wavelet.encode(STORED, texts)):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(wavelet, "MEMO", 3)
    test_encode()


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 3000])
def test_shard(size):
    rng = random.Random(size)
    choices = range(50) if size < 600 else [0, 1, 50256, 65535, *range(200)]
    ids = np.array([rng.choice(choices) for _ in range(size)], np.uint16)
    shard = wavelet.Shard(wavelet.pack([5, None], np.array([size // 2, size - size // 2]), ids, 16))
    assert shard.tokens().tolist() == ids.tolist() and shard.doc_ids == [5, None]
    for place in rng.sample(range(size), min(size, 40)):
        assert shard.access(place) == ids[place]
        assert shard.rank(int(ids[place]), place) == (ids[:place] == ids[place]).sum()
    for token in set(ids.tolist()[:30]):
        assert shard.occurrences(token) == np.flatnonzero(ids == token).tolist()
    assert shard.rank(1 << 17) == 0
    with pytest.raises(IndexError):
        shard.access(size)


def expected(rows):
    found, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in QUERIES["op6_wavelet"](spark, sf_dir).collect()) == expected([tuple(r) for r in rows])


@pytest.mark.parametrize("shard_tokens", [1 << 18, 10])
def test_odd_rows(spark, tmp_path, monkeypatch, shard_tokens):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
    rows = [(None, None), (None, "a"), (4, ""), (4, "b c"), (4, "b c"), (-7, "word " * 20_000), (9, "the end")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    for name, part in (("all", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        wavelet.write_shards(part, PATH, folder)
        found = wavelet.read_documents(spark.read.schema(wavelet.SHARDS).parquet(folder)).collect()
        made = sorted([(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found], key=lambda r: r[1])
        assert made == (expected(rows) if name == "all" else [])


def test_occurrences_over_shards(spark, tmp_path):
    sf_dir, folder = "/root/testdata/sf0.001", str(tmp_path / "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wavelet.write_shards(docs, PATH, folder)
    wanted = set()
    for doc_id, text in docs.collect():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        wanted |= {(doc_id, i) for i, t in enumerate(ids) if t == 290}
    found = wavelet.occurrences(spark.read.parquet(folder), 290).collect()
    assert len(wanted) > 100 and len(found) == len(wanted) and set(map(tuple, found)) == wanted


def test_copies_without_id_are_spread(spark, tmp_path):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'a copy' as text")
    wavelet.write_shards(docs, PATH, str(tmp_path / "shards"))
    rows = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert len(rows) == 8 and max(r.n_tokens for r in rows) < 1.5 * min(r.n_tokens for r in rows)


def test_encode_hostile_borders():
    rng = random.Random(5)
    letters = " \n\n\r\t a'sS.,é1 \x1c!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    for text, ids in zip(texts, wavelet.encode(STORED, texts)):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)
