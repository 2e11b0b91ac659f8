"""The pipeline's filters on tables of any shape: they keep all columns as they are and crash on none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcloom.llm import bpe, decontaminate, quality, simhash, toxicity
from srcloom.llm.queries import WORD_BPE

COLUMNS = """doc_id long, text string, `a.b` int, `_text` string, `_quality` double, `_toxicity` double, score double, t string,
_own_hash long, hash long, k0 int, own_0 string, place int, row long, `_spans` int, m map<string,int>, `group` int, f0 int"""


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["plain words of a text " * 5, None, "", "the benchmark item stands here in full", "plain words of a text " * 5]
    rows = [(i % 4 or None, t, i, "own", 0.5, 0.25, 0.75, "t", i, -i, i, "zero", i, i, i, {"k": i}, i, i) for i, t in enumerate(texts * 4)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def filters(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "benchmark item stands here")], "item_id long, text string")
    return {
        "toxicity": lambda docs: toxicity.reject_toxic(docs, labels),
        "quality": lambda docs: quality.reject_poor(docs, labels),
        "simhash": simhash.keep_one,
        "decontaminate": lambda docs: decontaminate.remove_contaminated(docs, items),
    }


def plain(df):
    return [repr(r) for r in df.collect()]


@pytest.mark.parametrize("name", ["toxicity", "quality", "simhash", "decontaminate"])
def test_filters_keep_rows_as_they_are(spark, odd, filters, name):
    kept = filters[name](odd)
    assert kept.schema.names == odd.schema.names and [f.dataType for f in kept.schema] == [f.dataType for f in odd.schema]
    mine, rest = plain(kept), plain(odd)
    assert mine and set(mine) <= set(rest)
    assert plain(filters[name](odd.limit(0))) == []
    if name == "simhash":
        assert len(mine) < len(rest)
    if name == "decontaminate":
        assert len(mine) == 16


def test_tokens_of_any_table(odd):
    vocabulary = bpe.read_vocabulary(bpe.tokenizer_path(WORD_BPE))
    found = bpe.with_decoded(bpe.with_ids(odd, vocabulary, odd.columns), vocabulary, [*odd.columns, "ids"])
    assert found.count() == 20 and set(odd.columns) <= set(found.columns)


def test_languages_only_where_there_are_some(spark, filters):
    docs = spark.createDataFrame([(1, "a text"), (2, "bad text")], "doc_id long, text string")
    assert filters["toxicity"](docs).columns == ["doc_id", "text"]
    numbers = docs.withColumn("LANG", F.lit(None).cast("string"))
    assert filters["toxicity"](numbers).columns == ["doc_id", "text", "LANG"]
