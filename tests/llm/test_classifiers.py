"""Toxicity and quality: held-out accuracy, defined cases."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcloom.llm import quality, toxicity
from srcloom.llm.common import LOWER, UPPER, fold, slices, table, text_words
from srcloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_of_texts():
    texts = ["", "Ab c1-é", "x", "  ", "\x7f`{A}ÉÉ_b", "a" * 5]
    words, firsts = text_words(pa.array(texts))
    found = [[w.decode() for w in words.to_pylist()[a:b]] for a, b in zip(firsts, firsts[1:])]
    assert found == [WORD.findall(t.translate(str.maketrans(UPPER, LOWER))) for t in texts]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * n for n in (3, 50, 0, 4, 4)])], ["i", "t"])
    parts = list(slices(batch.slice(1), 1, 8))
    assert [p.column(0).to_pylist() for p in parts] == [[1], [2, 3, 4]]


def held_out(spark, name, label):
    found = QUERIES[name](spark, LARGE).join(table(spark, LARGE, "labels"), "doc_id").where(F.col(label).isNotNull())
    return found.where("held_out").select("score", label).toPandas()


def test_toxicity_on_held_out_documents(spark):
    rows = held_out(spark, "op2_toxicity", "toxic")
    wrong = (rows.score >= 0.5) != (rows.toxic == 1)
    assert len(rows) > 700 and wrong[rows.toxic == 1].mean() < 0.2 and wrong[rows.toxic == 0].mean() < 0.02


def test_quality_on_held_out_documents(spark):
    rows = held_out(spark, "op9_quality", "quality")
    wrong = (rows.score >= 0.3) != (rows.quality == 1)
    assert len(rows) > 700 and wrong.mean() < 0.02


def test_thresholds_count_every_labelled_document(spark):
    """The documents of one language are all too long for the sample."""
    ids = range(700)
    lang = lambda i: "xx" if i % 3 == 0 else "en"
    words = lambda i: ["vile", "mild"][i % 2 if i % 7 else 1 - i % 2] + f" plain w{i % 5}"
    rows = [(i, f"{words(i)} " + "and so on " * (2500 if lang(i) == "xx" else 3), lang(i)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    scored = toxicity.with_scores(docs, model, ["doc_id", "lang"]).where(fold(F.col("doc_id")) == 4).collect()
    assert {"xx", "en"} < {*model.thresholds}
    for name, cut in model.thresholds.items():
        own = [(r.score, 1 - r.doc_id % 2) for r in scored if name in ("", r.lang)]
        wrong = [sum((s >= c) != t for s, t in own) for c in toxicity.CUTS]
        good = [c for c, w in zip(toxicity.CUTS, wrong) if w == min(wrong)]
        assert cut == min(good, key=lambda c: abs(c - 0.5))


ODD = [(1, None, None, 7), (2, "", "xx", 7), (None, "some text", "en", 7), (3, "b " * 200_000, "en", 7), (3, "b c", "en", 7)]
ODD_SCHEMA = "doc_id long, text string, lang string, Score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, None), (2, None, 1), (3, 0, 0), (None, 1, 1), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_of_odd_rows(spark, odd, labels):
    model = toxicity.train(odd, labels)
    rows = toxicity.with_scores(odd, model, odd.columns).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert [c.lower() for c in rows[0].asDict()].count("score") == 1
    trained = toxicity.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    rows = toxicity.with_scores(odd, trained, ["doc_id", "text"]).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.reject_toxic(odd.limit(0), labels).count() == 0
    assert toxicity.reject_toxic(odd, labels.limit(0)).columns == odd.columns


def test_quality_of_odd_rows(spark, odd, labels):
    assert quality.train(odd, labels.limit(0)) is None and quality.train(odd.limit(0), labels) is None
    rows = quality.with_scores(odd, None, odd.columns).collect()
    assert [r["score"] for r in rows] == [1.0] * len(ODD)
    trained = quality.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    rows = quality.with_scores(odd, trained, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.reject_poor(odd, labels).columns == odd.columns


def test_scores_do_not_depend_on_the_batch(spark):
    texts = [r.text for r in table(spark, SF_DIR, "documents").select("text").limit(50).collect()] + [""]
    together = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([t])) for t in texts])
    assert np.allclose(together, alone)
    model = toxicity.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    buckets, firsts = toxicity.hashed_words(pa.array(texts))
    whole = toxicity.score_words(model, buckets, firsts)
    single = [toxicity.score_words(model, *toxicity.hashed_words(pa.array([t])))[0] for t in texts]
    assert np.allclose(whole, single)


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 30, n).astype(np.int32) for n in (0, 1, 2, 7, 40)]
    label = np.array([0, 1, 0, 1, 1])
    model = toxicity.fit(words, label, np.zeros(5, bool))
    firsts = np.cumsum([0, *map(len, words)])
    found = toxicity.score_words(model, np.concatenate(words), firsts)
    for text, score in zip(words, found):
        rows = [*model.row_of[text].tolist(), 0, 0, 0]
        best = np.full(toxicity.FILTERS * len(toxicity.WIDTHS), -np.inf)
        for at in range(len(text) + 1):
            for k, width in enumerate(toxicity.WIDTHS):
                own = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
                z = np.zeros(toxicity.FILTERS)
                for j in range(width):
                    part = model.tables[j][rows[at + j]]
                    shift = len(best) - len(part)
                    z += part[own.start - shift : own.stop - shift]
                best[own] = np.maximum(best[own], z)
        value = np.maximum(best + model.bias, 0) @ model.weights + model.intercept
        assert abs(1 / (1 + np.exp(-value)) - score) < 1e-5


def test_folds(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("f", fold(F.col("doc_id")))
    for r in rows.collect():
        assert r.f == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5
