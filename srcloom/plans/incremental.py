"""Runs that take up where the one before left off: changed files are parsed, totals are kept up by differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.operators import chunks as ck
from srcloom.operators import reports, snapshot, stored
from srcloom.operators.functions_table import explode_functions, parse_files, without_bodies
from srcloom.operators.results import MISSING, OK
from srcloom.plans.analysis import analyze_parsed
from srcloom.session import written
from srcloom.sources.files import filter_sources, load_files, plain_root

# Counters of a file that a project's totals are sums of.
COUNTERS = [
    "files", "successful_files", "chunks", "successful_chunks", "failed_chunks", "invalid_chunks", "total_tokens",
    "functions", "lines", "analyzer_tokens",
]
TABLES = ("files", "outcomes", "results")
# Paths of changed files that a scan is given at a time.
PATHS_AT_ONCE = 10_000


def file_counters(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """A row per file: its outcome and reason, and what it adds to each counter."""
    outcomes = reports.file_outcome(parsed, results)
    tokens = F.col("tokens_used")
    sums = results.groupBy(F.col("file_path").alias("path")).agg(
        F.count_if(F.col("status") != MISSING).alias("functions"),
        F.sum(F.when(F.col("status") != MISSING, F.col("line_count"))).cast("long").alias("lines"),
        F.sum(F.when(F.col("status") == OK, tokens)).alias("analyzer_tokens"),
    )
    zero = F.lit(0).cast("long")
    rows = outcomes.join(sums, "path", "left").select(
        "path",
        "outcome",
        "reason",
        F.lit(1).cast("long").alias("files"),
        (F.col("outcome") == "successful").cast("long").alias("successful_files"),
        *[F.coalesce(c, zero).cast("long").alias(c) for c in COUNTERS[2:]],
    )
    return rows.select("path", "outcome", "reason", *COUNTERS)


def _state(spark: SparkSession, store: str) -> dict[str, int]:
    """Totals and table versions of the last finished run."""
    runs = spark.read.parquet(f"{store}/runs")
    return runs.orderBy(F.desc("run")).limit(1).first().asDict()


def start(spark: SparkSession, store: str, parts: int = stored.PARTS) -> None:
    """An empty store."""
    schemas = {"files": "path string, hash string", "outcomes": "path string, outcome string, reason string, " + ", ".join(f"{c} long" for c in COUNTERS)}
    for name, schema in schemas.items():
        stored.create(spark.createDataFrame([], schema), f"{store}/{name}", "path", parts)
    row = {"run": 0, **dict.fromkeys(COUNTERS, 0), **dict.fromkeys(TABLES_AT, 0), "parsed_files": 0, "parts": parts}
    _record(spark, store, row)


TABLES_AT = [f"{name}_version" for name in TABLES]


def _record(spark: SparkSession, store: str, row: dict[str, int]) -> None:
    schema = ", ".join(f"{c} long" for c in row)
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(f"{store}/runs")


def update(
    spark: SparkSession,
    store: str,
    listed: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    responses: DataFrame,
    max_tokens: int = ck.MAX_CHUNK_TOKENS,
    version: str | None = None,
) -> dict[str, int]:
    """Bring a store up to the snapshot ``listed`` (path, hash) and the replies; totals and versions afterwards.

    ``load`` gets the paths to read and gives their file records. These are the added and changed files, and those
    with a chunk whose reply was missing and has come. Their old rows are taken off the totals and their new ones
    added; rows of other files are neither parsed nor read, but for parts that share a hash with them. The run counts
    once its line is in ``runs``: one that fails before leaves the state as it was, and is simply repeated.
    """
    before = _state(spark, store)
    known = stored.read(spark, f"{store}/files", before["files_version"])
    diff = written(snapshot.snapshot_diff(known, listed), "differences")
    has_results = before["run"] > 0
    again = diff.limit(0).select("path")
    if has_results:
        waiting = stored.read(spark, f"{store}/results", before["results_version"]).where(F.col("status") == MISSING)
        came = waiting.join(responses.select("chunk_id").distinct(), "chunk_id", "left_semi")
        again = came.select(F.col("file_path").alias("path")).distinct()
    new = diff.where(F.col("change").isin("added", "changed")).select("path")
    old = diff.where(F.col("change").isin("removed", "changed")).select("path")
    removed = diff.where(F.col("change") == "removed").select("path")
    fresh = written(new.unionAll(again).distinct().join(removed, "path", "left_anti"), "fresh-paths")
    stale = written(old.unionAll(again).distinct(), "stale-paths")

    # Neither totals nor results have the text of a function, and only replies to these files' chunks are validated.
    parsed = written(without_bodies(ck.with_file_context(parse_files(load(fresh)))).drop("content"), "parsed")
    asked = explode_functions(parsed).select("chunk_id").distinct()
    answers = responses.join(asked, "chunk_id", "left_semi")
    results = written(analyze_parsed(parsed, answers, max_tokens, version), "results")
    counters = written(file_counters(parsed, results), "counters")

    gone = stored.read(spark, f"{store}/outcomes", before["outcomes_version"], keys=stale).join(stale, "path", "left_semi")
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    less, more = gone.agg(*sums).first(), counters.agg(*sums).first()
    totals = {c: before[c] - (less[c] or 0) + (more[c] or 0) for c in COUNTERS}

    after = {"run": before["run"] + 1, **totals}
    hashes = listed.select("path", "hash").join(new, "path", "left_semi")
    after["files_version"] = stored.replace(spark, f"{store}/files", old, hashes, before["files_version"])
    after["outcomes_version"] = stored.replace(spark, f"{store}/outcomes", stale, counters, before["outcomes_version"])
    if has_results:
        paths = stale.select(F.col("path").alias("file_path"))
        after["results_version"] = stored.replace(spark, f"{store}/results", paths, results, before["results_version"])
    else:
        after["results_version"] = stored.create(results, f"{store}/results", "file_path", before["parts"])
    _record(spark, store, after | {"parsed_files": counters.count(), "parts": before["parts"]})
    return after


def results(spark: SparkSession, store: str) -> DataFrame:
    return stored.read(spark, f"{store}/results", _state(spark, store)["results_version"])


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    return stored.read(spark, f"{store}/outcomes", _state(spark, store)["outcomes_version"])


def run_stats(spark: SparkSession, store: str) -> DataFrame:
    """The row that ``reports.run_stats`` gives for a full run, from the totals."""
    last = spark.read.parquet(f"{store}/runs").orderBy(F.desc("run")).limit(1)
    error_rate = reports.rate(F.col("failed_chunks"), F.col("chunks"))
    return last.select(
        F.col("files").alias("total_files"),
        "successful_files",
        (F.col("files") - F.col("successful_files")).alias("failed_files"),
        F.col("chunks").alias("total_chunks"),
        "successful_chunks",
        "failed_chunks",
        "invalid_chunks",
        "total_tokens",
        error_rate.alias("error_rate"),
    ).withColumn("success_rate", F.lit(1.0) - F.col("error_rate"))


def update_folder(
    spark: SparkSession, store: str, root: str, responses: DataFrame, include_headers: bool = True, **options: object
) -> dict[str, int]:
    """``update`` for a folder. A file counts as changed when its length or time of change differs; the bytes of others
    are not read. Paths of changed files pass through the driver, as those of any scan do."""
    base = plain_root(spark, root)
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    names = binary.load(root).select(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "").alias("path"), "length", "modificationTime")
    stamp = F.concat_ws("-", "length", F.unix_micros("modificationTime"))
    listed = filter_sources(names, include_headers).select(tx.relative_path(F.col("path"), base).alias("path"), stamp.alias("hash"))
    whole = written(listed, "listing")

    def load(fresh: DataFrame) -> DataFrame:
        paths = [f"{root.rstrip('/')}/{r['path']}" for r in fresh.toLocalIterator()]
        found = None
        for at in range(0, len(paths), PATHS_AT_ONCE):
            read = binary.load(paths[at : at + PATHS_AT_ONCE])
            part = load_files(read.select(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "").alias("path"), F.col("content").alias("bytes")), root)
            found = part if found is None else found.unionAll(part)
        if found is None:
            none = spark.createDataFrame([], "path string, bytes binary")
            return load_files(none, root)
        return found

    return update(spark, store, whole, load, responses, **options)
