"""C source extraction: a scanner over Arrow batches of texts, and two directive lists.

One file is one row, and each row is scanned where it is read; nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.cscan import scan
from srcloom.session import ship_package

FUNCTIONS_TYPE = (
    "array<struct<name:string,signature:string,body:string,start_line:int,end_line:int,"
    "params:array<string>,return_type:string>>"
)
REJECTS_TYPE = "array<struct<start_line:int,reason:string>>"
_SCANNED = f"struct<functions:{FUNCTIONS_TYPE},rejects:{REJECTS_TYPE},open_depth:int>"
_FUNCTION = pa.struct(
    [
        ("name", pa.string()), ("signature", pa.string()), ("body", pa.string()), ("start_line", pa.int32()),
        ("end_line", pa.int32()), ("params", pa.list_(pa.string())), ("return_type", pa.string()),
    ]
)
_REJECT = pa.struct([("start_line", pa.int32()), ("reason", pa.string())])
_ARROW = pa.struct([("functions", pa.list_(_FUNCTION)), ("rejects", pa.list_(_REJECT)), ("open_depth", pa.int32())])


def _scan_batch(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else scan(t) for t in texts.to_pylist()], _ARROW)


def parse_source(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``functions``, ``rejects`` (blocks that are no function, each with its line and reason) and
    ``open_depth`` (braces that nothing closes) to rows of texts, without a shuffle; null for a null text.
    """
    ship_package(files.sparkSession)
    # Not to be evaluated once for each column that reads it.
    scanned = F.arrow_udf(_scan_batch, _SCANNED).asNondeterministic()
    return files.withColumn("_scanned", scanned(F.col(content))).select(
        *files.columns,
        F.col("_scanned.functions").alias("functions"),
        F.col("_scanned.rejects").alias("rejects"),
        F.col("_scanned.open_depth").alias("open_depth"),
    )


def include_names(content: Column) -> Column:
    """Names in include directives, in order."""
    return F.regexp_extract_all(content, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'), F.lit(1))


def macro_names(content: Column) -> Column:
    """Names in define directives, in order."""
    return F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)"), F.lit(1))
