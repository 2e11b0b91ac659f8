"""Keyed tables on shared storage that are changed by rewriting the touched parts alone.

Rows lie in parts by a hash of their key. A change reads and writes only the parts that hold one of its keys, into a new
folder, and then appends one small manifest file that says where each part of the new version is. So a reader
sees the old version or the new one, a change that fails leaves the old one, old versions stay readable, and a
change costs in proportion to what it touches. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = 64
# Column of the part in the folders' names.
PLACE = "stored_part"
# One row for each part of a version; the number of parts bounds what the driver reads.
MANIFEST = "version long, part int, path string, key string, parts int, schema string"


def _manifests(folder: str) -> str:
    return f"{folder.rstrip('/')}/manifests"


def latest_version(spark: SparkSession, folder: str) -> int:
    return spark.read.schema(MANIFEST).parquet(_manifests(folder)).agg(F.max("version")).first()[0]


def _state(spark: SparkSession, folder: str, version: int | None) -> tuple[int, dict[int, str | None], str, int, StructType]:
    version = latest_version(spark, folder) if version is None else version
    rows = spark.read.schema(MANIFEST).parquet(_manifests(folder)).where(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"no version {version} in {folder}")
    schema = StructType.fromJson(json.loads(rows[0]["schema"]))
    return version, {r["part"]: r["path"] for r in rows}, rows[0]["key"], rows[0]["parts"], schema


def _commit(spark: SparkSession, folder: str, version: int, paths: dict[int, str | None], key: str, schema: StructType) -> int:
    rows = [(version, part, path, key, len(paths), schema.json()) for part, path in paths.items()]
    # One file, which appears as a whole.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(_manifests(folder))
    return version


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias(PLACE)


def _write(rows: DataFrame, folder: str, key: str, parts: int) -> dict[int, str]:
    """Parts that have rows, and where they are. A part larger than others is written by several tasks."""
    spark, to = rows.sparkSession, f"{folder.rstrip('/')}/data/{uuid.uuid4().hex}"
    placed = rows.select("*", _part(key, parts))
    placed.hint("rebalance", PLACE).write.partitionBy(PLACE).parquet(to)
    found = spark.read.schema(placed.schema).parquet(to).select(PLACE).distinct().collect()
    return {r[0]: f"{to}/{PLACE}={r[0]}" for r in found}


def create(rows: DataFrame, folder: str, key: str, parts: int = PARTS) -> int:
    """Store a table as version 0."""
    paths = _write(rows, folder, key, parts)
    return _commit(rows.sparkSession, folder, 0, {p: paths.get(p) for p in range(parts)}, key, rows.schema)


def read(spark: SparkSession, folder: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """A version of the table, or the parts of it that hold one of the keys."""
    _, paths, key, parts, schema = _state(spark, folder, version)
    wanted = paths if keys is None else _touched(keys, key, parts)
    return _rows(spark, [paths[p] for p in wanted], schema)


def _touched(keys: DataFrame, key: str, parts: int) -> list[int]:
    return [r[0] for r in keys.select(_part(key, parts)).distinct().collect()]


def _rows(spark: SparkSession, paths: Sequence[str | None], schema: StructType) -> DataFrame:
    present = [p for p in paths if p is not None]
    return spark.read.schema(schema).parquet(*present) if present else spark.createDataFrame([], schema)


def replace(
    spark: SparkSession, folder: str, gone: DataFrame, fresh: DataFrame | None = None, version: int | None = None
) -> int:
    """A new version without the rows of the keys ``gone`` and with the rows ``fresh``; only parts of their keys are read
    and written. It is based on ``version``, the latest if none is named. Keys with unchanged rows need not be named."""
    newest = latest_version(spark, folder)
    _, paths, key, parts, schema = _state(spark, folder, version)
    away = gone.select(F.col(key).alias("away")).distinct()
    keys = gone.select(key) if fresh is None else gone.select(key).unionAll(fresh.select(key))
    touched = _touched(keys, key, parts)
    kept = _rows(spark, [paths[p] for p in touched], schema)
    rows = kept.join(away, F.col(key).eqNullSafe(F.col("away")), "left_anti")
    if fresh is not None:
        rows = rows.unionAll(fresh.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
    made = _write(rows, folder, key, parts)
    return _commit(spark, folder, newest + 1, paths | {p: made.get(p) for p in touched}, key, schema)


def upsert(spark: SparkSession, folder: str, incoming: DataFrame) -> int:
    """Rows of a table with unique keys replaced or added to; of several incoming rows of a key the greatest counts."""
    _, _, key, _, schema = _state(spark, folder, None)
    others = [f.name for f in schema if f.name != key]
    fresh = incoming.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, *[f"r.{c}" for c in others])
    return replace(spark, folder, incoming, fresh)
