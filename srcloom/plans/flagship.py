"""Sources to functions, token budget and one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.operators.functions_table import extract_functions
from srcloom.plans import tables
from srcloom.plans.analysis import chunk_rows
from srcloom.session import tune


def functions_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = extract_functions(tables.sources(tune(spark), sf_dir))
    return chunk_rows(functions).groupBy("file_path").agg(
        F.count("*").alias("function_count"), F.sum("tokens").alias("total_tokens")
    )
