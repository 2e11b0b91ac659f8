"""Sinks for tables and documents. Each writes one directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Quotes doubled, blanks kept, a header in each file.
CSV = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(table: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """CSV with a header in each part file, quotes doubled as in RFC 4180."""
    table.write.mode(mode).options(**CSV).csv(folder)


def write_json(table: DataFrame, folder: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).json(folder)


def write_parquet(table: DataFrame, folder: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).parquet(folder)


def write_documents(rows: DataFrame, folder: str, order: list[str], by_file: bool = False) -> None:
    """Document rows as text in their order: part files in sequence hold the documents.

    The range partitioning splits a document that is larger than a partition. ``by_file``
    adds one folder per file, for projects with few enough files for that.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The text writer ends each row with a line break itself.
    text = F.regexp_replace("text", r"\n\z", "").alias("value")
    if by_file:
        ordered.select("file_path", text).write.mode("overwrite").partitionBy("file_path").text(folder)
    else:
        ordered.select(text).write.mode("overwrite").text(folder)


def results_json(results: DataFrame) -> DataFrame:
    """Result rows as one JSON text each."""
    return results.select("file_path", "start_line", F.to_json(F.struct(*results.columns)).alias("json"))
