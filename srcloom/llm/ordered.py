"""Documents in the order of their ids, over many tasks, in ranges of similar numbers of bytes.

Rows go by id, the first ``HEAD`` characters of the text, a hash of the text and the place where they were read, so
rows of equal or missing ids, and copies, are spread like others. These keys are sorted and numbered
with running sizes, without the texts; the first key of each range, one for each task to come, is what the driver
gets. A row's range is then found by bisection, and Spark sends the row straight to the task of that number.

The table must read the same way twice, as files do.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_ready
from srcloom.operators.ordering import with_global_position

HEAD = 64
LEAST_ID = -(1 << 63)
KEY = ["o_at", "o_head", "o_hash", "o_read"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, keys) of a table; a null id stands before all others, a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(LEAST_ID)).alias("o_at"),
        F.substring("text", 1, HEAD).alias("o_head"),
        F.xxhash64("text").alias("o_hash"),
        F.monotonically_increasing_id().alias("o_read"),
    )


def directed(descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in KEY]


def range_heads(rows: DataFrame, descending: bool = False) -> list[tuple]:
    """First key of each range, in ascending order of keys whatever the direction; at most one for each task."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sized = rows.select(*KEY, (F.octet_length("text") + 64).cast("long").alias("size"))
    upto = with_global_position(sized, directed(descending), {"upto": "size"})
    total = upto.agg(F.max("upto")).first()[0]
    if total is None:
        return []
    step = -(-total // n)
    last = F.expr(f"(upto - 1) div {step}")
    first = (F.col("position") == 1) | (last > F.expr(f"(upto - 1 - size) div {step}"))
    return sorted(tuple(r) for r in upto.where(first).select(*KEY).collect())


def in_ranges(rows: DataFrame, heads: list[tuple], descending: bool = False) -> DataFrame:
    """Adds the number ``place`` of each row's range."""
    shared = arrow_ready(rows.sparkSession).sparkContext.broadcast(heads)

    @F.pandas_udf("int")
    def place(at: pd.Series, head: pd.Series, hashed: pd.Series, read: pd.Series) -> pd.Series:
        own = shared.value
        keys = zip(at.tolist(), head.tolist(), hashed.tolist(), read.tolist())
        if descending:
            return pd.Series([len(own) - 1 - bisect_left(own, k) for k in keys], dtype="int32")
        return pd.Series([bisect_right(own, k) - 1 for k in keys], dtype="int32")

    return rows.withColumn("place", place(*KEY))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ascending order within and over partitions."""
    rows = keyed(docs)
    heads = range_heads(rows)
    placed = in_ranges(rows, heads).repartitionById(max(1, len(heads)), "place")
    return placed.sortWithinPartitions(*KEY).select("doc_id", "text")
