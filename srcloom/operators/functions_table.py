"""Functions of source files, one row per file or one row per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.functions.csource import FUNCTIONS_TYPE, REJECTS_TYPE, parse_source

LANGUAGES = ("c", "cpp")


def parse_files(files: DataFrame) -> DataFrame:
    """Add the functions array, the rejected blocks and a parse status to file rows.

    C files are parsed; C++ is not supported and its files carry an error. A file with a brace that nothing
    closes carries one too, and keeps the complete functions ('partial').
    """
    supported = F.col("language") == "c"
    # Texts of other languages are not scanned at all.
    parsed = parse_source(files.withColumn("_c_text", F.when(supported, F.col("content"))), "_c_text")
    foreign = F.when(F.col("language") == "cpp", F.lit("C++ parsing is not supported")).when(
        ~supported, F.concat(F.lit("Unsupported language: "), F.col("language"))
    )
    error = F.coalesce(foreign, F.when(F.col("open_depth") != 0, F.lit("unbalanced braces")))
    return parsed.select(
        *files.columns,
        F.coalesce("functions", F.array().cast(FUNCTIONS_TYPE)).alias("functions"),
        F.coalesce("rejects", F.array().cast(REJECTS_TYPE)).alias("rejects"),
        F.coalesce("open_depth", F.lit(0)).alias("open_depth"),
        error.alias("parse_error"),
        F.when(error.isNotNull() & (F.size("functions") > 0), F.lit("partial"))
        .when(error.isNotNull(), F.lit("error"))
        .when(F.size("functions") == 0, F.lit("no functions"))
        .otherwise(F.lit("parsed"))
        .alias("parse_status"),
    )


def rejected_blocks(parsed: DataFrame) -> DataFrame:
    """One row per braced block at the top level that is no function."""
    return parsed.select("path", F.inline("rejects"))


def check_language(language: str) -> str:
    """Language a caller asks to parse; raises as parsing by row would report an error."""
    if language == "cpp":
        raise NotImplementedError("C++ parsing is not supported")
    if language not in LANGUAGES:
        raise ValueError(f"Unsupported language: {language}")
    return language


def without_bodies(parsed: DataFrame) -> DataFrame:
    """Parsed files whose functions have their content id and token estimate in place of their text, for tables that
    are stored and read again by what needs no text."""
    kept = ("name", "signature", "start_line", "end_line", "params", "return_type")
    digest = F.transform(
        "functions",
        lambda f: F.struct(
            *[f[c].alias(c) for c in kept],
            tx.content_hash(f["body"]).alias("chunk_id"),
            tx.token_estimate(f["body"]).alias("tokens"),
        ),
    )
    return parsed.withColumn("functions", digest)


def explode_functions(parsed: DataFrame) -> DataFrame:
    """One row per function with its position and count within the file.

    Both come from the array of the file's row, so no window over the file is needed.
    """
    rows = parsed.select(
        F.col("path").alias("file_path"),
        F.size("functions").alias("function_count"),
        F.posexplode("functions").alias("pos", "f"),
    )
    return rows.select(
        "file_path",
        "f.*",
        (F.col("f.end_line") - F.col("f.start_line") + 1).alias("line_count"),
        (F.col("pos") + 1).alias("position"),
        "function_count",
    )


def extract_functions(files: DataFrame) -> DataFrame:
    return explode_functions(parse_files(files))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_error").isNotNull()).select(
        "path", F.col("parse_error").alias("error")
    )


def files_without_functions(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("functions") == 0)
