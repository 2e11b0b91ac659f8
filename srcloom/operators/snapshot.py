"""Snapshot difference, content cache and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.operators.skew import join_unique

TTL_DAYS = 30


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, changed, removed and same paths of two snapshots with unique paths.

    Only paths and hashes meet in the join, never file contents.
    """
    before = old.select("path", F.col("hash").alias("old_hash"))
    after = new.select("path", F.col("hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), F.lit("added"))
        .when(F.col("new_hash").isNull(), F.lit("removed"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return before.join(after, "path", "full_outer").select("path", "old_hash", "new_hash", change.alias("change"))


def apply_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot from the old one: drop removed and changed paths, add those of the new."""
    diff = snapshot_diff(old, new)
    stale = diff.where(F.col("change").isin("removed", "changed")).select("path")
    fresh = diff.where(F.col("change").isin("added", "changed")).select("path")
    kept = old.join(stale, "path", "left_anti")
    return kept.unionByName(new.join(fresh, "path", "left_semi"))


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    return join_unique(files, cache.select("hash").distinct(), "hash", "left_semi")


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return join_unique(files, cache.select("hash").distinct(), "hash", "left_anti")


def cache_split(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with ``cached`` in one join, for callers that need both halves."""
    known = cache.select("hash").distinct().withColumn("_hit", F.lit(True))
    joined = join_unique(files, known, "hash")
    return joined.select(*files.columns, F.coalesce("_hit", F.lit(False)).alias("cached"))


def cache_latest(cache: DataFrame) -> DataFrame:
    """Latest entry per hash, as saving overwrites; ties go to the greatest path."""
    others = [c for c in cache.columns if c != "hash"]
    rank = F.struct("ts", *[c for c in others if c != "ts"])
    return cache.groupBy("hash").agg(F.max(rank).alias("e")).select("hash", *[f"e.{c}" for c in others])


def within_ttl(cache: DataFrame, as_of: str, days: int = TTL_DAYS) -> DataFrame:
    """Entries no older than ``days`` at ``as_of`` (a timestamp text)."""
    return cache.where(F.expr(f"ts >= timestamp_ntz'{as_of}' - interval {days} days"))


def delete_by_file(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks without those of the given ``file_path`` values."""
    return join_unique(chunks, paths.select("file_path").distinct(), "file_path", "left_anti")


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of a table with unique keys, replaced or added to by incoming rows.

    Only the keys of the incoming rows meet the table, so a small batch is broadcast by its
    size and the table stays where it is.
    """
    columns = table.columns
    others = [c for c in columns if c != key]
    fresh = incoming.groupBy(key).agg(F.max(F.struct(*others)).alias("r"))
    kept = table.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.select(*columns).unionByName(fresh.select(key, *[f"r.{c}" for c in others]).select(*columns))
