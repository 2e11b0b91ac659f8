"""Neighbours of rows over ranges of a table, hot groups included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcloom.operators import ordering
from srcloom.operators.chunks import overlap_parts


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    found = []
    for i, (g, n, _) in enumerate(rows):
        before = rows[i - 1] if i and rows[i - 1][0] == g else None
        after = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == g else None
        found.append((g, n, before and before[2][-2:], after and after[2][:2]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_neighbours_with_a_hot_file(spark, batch):
    """A third of all parts are of one file; it lies in several ranges, and each row sees its neighbours."""
    rows = [("hot" if i % 3 == 0 else f"f{i % 40}" if i % 11 else None, i, f"text {i} end{i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "path string, n int, code string").repartition(5, "code")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    # Ranges as small as these would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ordering.with_neighbours(table, "path", ["n"], F.right("code", F.lit(2)), F.left("code", F.lit(2)))
        got = sorted((tuple(r) for r in found.select("path", "n", "before", "after").collect()), key=repr)
        ranges = {r[0] for r in found.where("path = 'hot'").select(F.spark_partition_id()).distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain(rows) and len(ranges) >= 3


def test_overlap_of_parts(spark):
    rows = [("a.c", 1, "1\n2\n3"), ("a.c", 2, "4"), ("a.c", 3, "5\n6\n7"), ("b.c", 1, "x\n\n")]
    parts = spark.createDataFrame(rows, "path string, part int, code string")
    found = {(r.path, r.part): r.code for r in overlap_parts(parts, "path", ["part"], lines=2).collect()}
    assert found == {("a.c", 1): "1\n2\n3\n4", ("a.c", 2): "2\n3\n4\n5\n6", ("a.c", 3): "4\n5\n6\n7", ("b.c", 1): "x\n\n"}
    assert overlap_parts(parts.limit(0), "path", ["part"]).count() == 0
