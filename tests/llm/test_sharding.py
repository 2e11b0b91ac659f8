"""Sharding: a permutation for every size, shards and slots against plain Python, rows of any kind."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcloom.llm import sharding
from srcloom.llm.common import table
from srcloom.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_every_row_has_a_place_of_its_own(n):
    rows = np.arange(n)
    found = sharding.permute(rows, n)
    assert sorted(found.tolist()) == rows.tolist()
    assert sharding.permute(found, n, back=True).tolist() == rows.tolist()


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 1 << 60), st.integers(0, 1 << 60), st.integers(1, 99), st.integers(0, 9))
def test_shard_and_slot_lead_back_to_the_row(n, row, shards, seed):
    row %= n
    assert sharding.row_at(*sharding.locate(row, n, shards, seed), n, shards, seed) == row


def test_order_is_shuffled_by_the_seed():
    a, b = sharding.permute(np.arange(1000), 1000), sharding.permute(np.arange(1000), 1000, seed=7)
    assert (a != b).mean() > 0.9 and (np.diff(a) == 1).mean() < 0.05
    assert a[:5].tolist() == sharding.permute(np.arange(5), 1000).tolist()


def test_row_beyond_the_table():
    with pytest.raises(ValueError):
        sharding.permute(np.array([3]), 3)


ROWS = [
    (3, "b", 1),
    (1, "ä\U0001f600", 2),
    (None, None, 3),
    (None, "", 4),
    (2, "same", 5),
    (2, "same", 5),
    (2, "other", 6),
    (9, "x" * 300_000, 7),
]


def expected(rows, shards):
    """Rows of equal id go by a hash of the text that only Spark computes, so these are not compared by place."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return {r[0]: sharding.locate(i, len(rows), shards) for i, r in enumerate(order) if r[0] in (1, 3, 9)}


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_places_of_rows(spark, shards):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, `k.Shard` int").withColumn("SLOT", F.lit("mine"))
    found = sharding.with_places(docs, docs.columns, shards)
    assert found.columns == ["doc_id", "text", "k.Shard", *sharding.OWN]
    rows = found.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    by_shard = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    places = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    for doc_id, place in expected(ROWS, shards).items():
        assert places[doc_id] == place


def test_same_places_however_the_rows_are_stored(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    one = sorted(map(tuple, sharding.with_places(docs.repartition(1), ["doc_id"]).collect()))
    many = sorted(map(tuple, sharding.with_places(docs.repartition(5, "text"), ["doc_id"]).collect()))
    assert one == many


def test_copies_without_id_fill_all_shards(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    counts = sharding.with_places(docs, []).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [25] * 16


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.with_places(docs, ["doc_id"]).collect() == []


def test_written_shards_hold_whole_rows_in_slot_order(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and set(back.columns) == {"doc_id", "text", *sharding.OWN}
    row = back.where("shard = 2 AND slot = 5").first()
    assert row["doc_id"] == sharding.row_at(2, 5, 100, 3)


def test_query_against_plain_python(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert len({r[0] for r in rows}) == len(rows)
    wanted = set()
    for number, r in enumerate(sorted(rows)):
        data = (r[1] or "").encode()
        wanted.add((r[0], len(data) + 1, zlib.crc32(data), "rows", *sharding.locate(number, len(rows)), None))
    found = QUERIES["op13_sharding"](spark, "/root/testdata/sf0.001")
    assert set(map(tuple, found.collect())) == wanted
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
