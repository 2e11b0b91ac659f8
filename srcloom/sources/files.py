"""Scan, decode and load source files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions import text as tx

LOADED = "loaded"
QUARANTINED = "quarantined"


# Scheme and authority of a path; neither is a folder.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?"
MAX_LENGTH = "spark.sql.sources.binaryFile.maxLength"
TOO_LARGE, UNREADABLE = "too large for a row", "unreadable"


def plain_root(spark: SparkSession, root: str) -> str:
    """A root as the paths below it begin in a scan: absolute, without scheme and authority."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub(_SCHEME, "", system.makeQualified(path).toString())


def list_files(
    spark: SparkSession, root: str, include_headers: bool = True, suffixes: tuple[str, ...] | None = None
) -> DataFrame:
    """Files below ``root`` (or ``root`` itself), filtered by suffix, with their bytes to be read on demand.

    Files that cannot be read give no row, instead of ending the job; a missing root raises.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    binary = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    files = binary.select(F.regexp_replace("path", _SCHEME, "").alias("path"), "length", F.col("content").alias("bytes"))
    if suffixes is not None:
        return files.where(tx.suffix(F.col("path")).isin(*suffixes))
    return filter_sources(files, include_headers)


def scan_files(
    spark: SparkSession,
    root: str,
    include_headers: bool = True,
    suffixes: tuple[str, ...] | None = None,
) -> DataFrame:
    """Files with their bytes, those apart that are too large for a row or cannot be read.

    Filters are on path and length, so Spark lists the files and reads none that fails one. Rows are
    unordered; sort by ``path`` at the sink.
    """
    return list_files(spark, root, include_headers, suffixes).where(F.col("length") <= _most(spark))


def unread_files(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, reason) of listed files that loading left out; both tables have paths of the same form."""
    reason = F.when(F.col("length") > _most(files.sparkSession), TOO_LARGE).otherwise(UNREADABLE)
    return listed.select("path", "length").join(files.select("path"), "path", "left_anti").select(
        "path", reason.alias("reason")
    )


def _most(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_LENGTH, str(2**31 - 1)))


def filter_sources(files: DataFrame, include_headers: bool = True) -> DataFrame:
    return files.where(tx.is_source_path(F.col("path"), include_headers))


def decoded(raw: Column) -> Column:
    """Text of raw bytes and the encoding that fits: UTF-8, else Latin-1, which fits any."""
    valid = F.is_valid_utf8(raw.cast("string"))
    utf8 = F.when(valid, raw.cast("string"))
    latin1 = F.decode(raw, "ISO-8859-1")
    return F.struct(
        tx.normalize_newlines(F.coalesce(utf8, F.when(~valid, latin1))).alias("content"),
        F.when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"),
    )


def load_files(files: DataFrame, root: str = "", raw: str = "bytes") -> DataFrame:
    """File records: path below root, name, content, language, hash, encoding, line count."""
    text = files.select("path", decoded(F.col(raw)).alias("text")).select("path", "text.*")
    path = tx.relative_path(F.col("path"), plain_root(files.sparkSession, root)) if root else F.col("path")
    return text.select(
        path.alias("path"),
        tx.file_name(F.col("path")).alias("name"),
        "content",
        tx.detect_language(F.col("path")).alias("language"),
        tx.content_hash(F.col("content")).alias("hash"),
        "encoding",
        tx.line_count(F.col("content")).alias("line_count"),
    )


def load_status(files: DataFrame, raw: str = "bytes", strict: bool = False) -> DataFrame:
    """Add ``status`` and ``reason``: an unreadable file is set aside and the rest goes on.

    A file without bytes is unreadable; with ``strict`` so is one that is not UTF-8.
    """
    reason = F.when(F.col(raw).isNull(), F.lit("no content"))
    if strict:
        reason = reason.when(~F.is_valid_utf8(F.col(raw).cast("string")), F.lit("not utf-8"))
    return files.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit(LOADED)).otherwise(F.lit(QUARANTINED))
    )
