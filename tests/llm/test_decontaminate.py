"""Suffix-array decontamination against windows in a dictionary."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcloom.llm import decontaminate
from srcloom.llm.common import LOWER, UPPER, table
from srcloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def plain(texts, items):
    """(words, hit words, item ids) of each text."""
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(len(words), 13)
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    found = []
    for text in texts:
        words, ids = words_of(text), set()
        hit = [False] * len(words)
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    ids |= own
                    hit[k : k + size] = [True] * size
        found.append((len(words), sum(hit), sorted(str(i) for i in ids if i is not None)))
    return found


def counted(spans):
    return sum(s["stop"] - s["start"] for s in spans)


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 8, 40])
def test_shards_against_windows(vocabulary):
    rng = np.random.default_rng(vocabulary)
    made = lambda n: " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))
    for _ in range(12):
        items = [(i, made(int(rng.integers(0, 40)))) for i in range(int(rng.integers(0, 8)))]
        texts = []
        for _ in range(20):
            text = made(int(rng.integers(0, 80)))
            if items and rng.random() < 0.6:
                part = items[int(rng.integers(0, len(items)))][1].split()
                text += " zzz " * int(rng.integers(0, 2)) + " " + " ".join(part[int(rng.integers(0, len(part) + 1)) :]) + ", " + made(3)
            texts.append(text)
        own = decontaminate.block([str(i) for i, _ in items], [t for _, t in items])
        rows = decontaminate.scan_shard(pa.array(texts, pa.string()), own)
        assert [(n, counted(spans), ids) for n, spans, ids, _ in rows] == plain(texts, items)
        for text, (_, _, _, matches) in zip(texts, rows):
            found = sorted((m["item_id"], m["n_words"], [(p["item_word"], p["doc_word"]) for p in m["places"]]) for m in matches)
            assert found == plain_matches(text, items)


def plain_matches(text, items):
    """The longest runs of equal words of each item that has a window in the text, by all pairs of places."""
    doc, found = words_of(text), []
    for name, item_text in items:
        item = words_of(item_text)
        runs = {}
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                    n += 1
                runs[i, j] = n
        longest = max(runs.values(), default=0)
        if item and longest >= min(len(item), 13):
            found.append((str(name), longest, sorted(p for p, n in runs.items() if n == longest)))
    return sorted(found)


def test_a_short_copy_does_not_hide_a_long_one():
    item = " ".join(f"w{i}" for i in range(50))
    head = " ".join(f"w{i}" for i in range(13))
    own = decontaminate.block(["a"], [item])
    for text, at in ((f"{head} x {item}", 14), (f"{item} x {head}", 0)):
        ((_, _, _, matches),) = decontaminate.scan_shard(pa.array([text]), own)
        assert matches == [{"item_id": "a", "n_words": 50, "places": [{"item_word": 0, "doc_word": at}]}]
    ((_, _, _, matches),) = decontaminate.scan_shard(pa.array([f"{item} . {item}"]), own)
    assert [p["doc_word"] for p in matches[0]["places"]] == [0, 50]


def test_words_repeated_many_times():
    own = decontaminate.block(["a", "b"], ["la " * 300, "la " * 20 + "lu"])
    ((n, spans, ids, matches),) = decontaminate.scan_shard(pa.array(["la " * 5000]), own)
    assert (n, spans, ids) == (5000, [{"start": 0, "stop": 5000}], ["a", "b"])
    assert [(m["item_id"], m["n_words"]) for m in matches] == [("a", 300), ("b", 20)]
    assert matches[0]["places"] == [{"item_word": 0, "doc_word": k} for k in range(4701)]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(3)
    for most in (1, 2, 5):
        text = rng.integers(0, most + 1, 300).astype(np.int64)
        suffixes, _ = decontaminate.suffix_array(text, 400, most)
        tails = []
        for s in suffixes.tolist():
            end = s
            while end < len(text) and text[end]:
                end += 1
            tails.append(text[s:end].tolist())
        assert tails == sorted(tails) and len(tails) == int((text > 0).sum())


def test_query_against_windows(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    expected = dict(zip(docs, plain(docs.values(), items)))
    rows = QUERIES["op3_decontamination"](spark, SF_DIR).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    docs, benchmark = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    whole = decontaminate.scan(docs, benchmark, ["doc_id"]).select("doc_id", "_n_words", "_spans", "_items", F.expr("array_sort(_matches)").alias("m"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert len(list(decontaminate.blocks(benchmark))) > 2
    parts = decontaminate.scan(docs, benchmark, ["doc_id"]).select("doc_id", "_n_words", "_spans", "_items", F.expr("array_sort(_matches)").alias("m"))
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "one two three"), (None, "four five"), (2, None), (3, "  "), (1, "six seven")], "item_id long, text string"
    )
    rows = [(1, None, 1), (2, "", 1), (2, "One, two; three!", 1), (None, "four five", 1), (3, "six seven " + "x " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans int")
    found = decontaminate.scan(docs, items, ["doc_id", "text"]).collect()
    assert [(r.doc_id, r["_n_words"], counted(r["_spans"]), r["_items"]) for r in found] == [
        (1, 0, 0, []), (2, 0, 0, []), (2, 3, 3, ["1"]), (None, 2, 2, []), (3, 50_002, 2, ["1"]),
    ]
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and [r.doc_id for r in clean.collect()] == [1, 2, 3]
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.scan(docs.limit(0), items, ["doc_id"]).count() == 0
