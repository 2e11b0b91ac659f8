"""What the operators share: Arrow settings, added columns, words of texts, label folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from srcloom.session import ship_package

# Rows and bytes that go to Python at once; one longer text goes alone.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
SLICE_BYTES = 2 << 20

FOLDS = 5

# ASCII upper and lower case letters, for translate().
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def arrow_ready(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once, and bound what one holds of a table."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """Columns that none of the names stands for, whatever the case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or of one row."""
    column = batch.column(text)
    sizes = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    docs: DataFrame,
    compute: Callable[[pa.StringArray, pa.RecordBatch], list[pa.Array]],
    fields: Sequence[StructField],
    keep: Sequence[str],
    text: str = "text",
    also: Sequence[str] = (),
) -> DataFrame:
    """Keep some columns and add others that are computed from whole texts, without a shuffle.

    ``compute`` gets the texts (null: empty) and the columns ``also`` of one slice. A kept column with the
    name of an added one, whatever its case, is replaced; other names cannot clash.
    """
    kept = without(keep, [f.name for f in fields])
    chosen = docs.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)],
        *[quoted(c).alias(f"a{i}") for i, c in enumerate(also)],
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("t"),
    )
    made_fields = [StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)]
    schema = StructType([*chosen.schema.fields[: len(kept)], *made_fields])
    names, place, n = schema.names, len(kept) + len(also), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                others = pa.RecordBatch.from_arrays(part.columns[n:place], names=list(also))
                made = compute(part.column(place), others)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)

    found = chosen.mapInArrow(run, schema)
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"f{i}").alias(f.name) for i, f in enumerate(fields)]
    )


def carried(docs: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns of a table under names that clash with nothing, and beside them those an operator reads by
    name, null where the table has none but a text. ``returned`` takes back the first."""
    present = {c.lower() for c in docs.columns}
    own = [f"own_{i}" for i in range(len(docs.columns))]
    read = [quoted(c).alias(c) if c in present or c == "text" else F.lit(None).cast("string").alias(c) for c in wanted]
    return docs.select(*[quoted(c).alias(o) for c, o in zip(docs.columns, own)], *read), own


def returned(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _word_bytes() -> np.ndarray:
    """By byte: itself in lower case where it belongs to a word, else 0."""
    kept = np.arange(256, dtype=np.uint8)
    kept[0:0x30] = kept[0x3A:0x41] = kept[0x5B:0x61] = kept[0x7B:0x80] = 0
    kept[0x41:0x5B] += 0x20
    return kept


WORD_BYTES = _word_bytes()


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def text_words(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of all texts in order, A-Z in lower case, and the index of each text's first word.

    Words are runs of digits, ASCII letters and characters beyond ASCII, whose UTF-8 bytes are all above
    0x7F; so bytes decide. The index array has one entry more than there are texts.
    """
    data, offsets = text_bytes(texts)
    kept = WORD_BYTES[data]
    inside = kept != 0
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - first + 1
    bounds = np.zeros(len(first) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    words = pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(kept[inside].tobytes())]
    )
    return words, np.searchsorted(first, offsets)
