"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text: it shifts by one bit and adds a fixed random number for each byte, so
its 32 bits depend on the last 32 bytes alone. A chunk ends where the hash's top bits are zero; before the
normal length more bits must be, after it fewer (normalised chunking). Boundaries follow the content, so an
insertion moves no boundary but those around it. The fingerprint is the set of (digest, length) of the
chunks; containment is the share of a set's total length that the other set has too.

``with_next`` pairs each document with the next by descending id, over ranges that are sorted apart (``ordered``), as
many as the session shuffles to or the input has splits: the first document of a range is also sent to the range
before it, and the very first one to the end.

Defined cases: a null text is empty; an empty text has the empty fingerprint, which any set contains in full (1),
while it contains nothing of another (0); repeated chunks count once; equal ids go by the beginning of the text, the greater first, then by a hash; a null
id is behind all others; a single document is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from srcloom.llm.common import arrow_ready
from srcloom.llm.ordered import KEY, directed, in_ranges, keyed, range_heads

LEAST, NORMAL, MOST = 16, 64, 255
# Zero bits asked for before and after the normal length; log2(NORMAL) is 6.
HARD, EASY = 8, 4
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)

PAIRED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_chars", LongType()),
        StructField("edited_sha256", StringType()),
        StructField("fingerprint", StringType()),
        StructField("edited_fingerprint", StringType()),
        StructField("near_edited", DoubleType()),
        StructField("near_next", DoubleType()),
    ]
)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if not n:
        return []
    hashed = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < 32 and reach < n:
        shifted = hashed[:-reach] << np.uint32(reach)
        hashed = hashed.copy()
        hashed[reach:] += shifted
        reach *= 2
    easy = np.flatnonzero(hashed >> np.uint32(32 - EASY) == 0)
    hard = (easy[hashed[easy] >> np.uint32(32 - HARD) == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    ends, start = [], 0
    while start < n:
        normal, last = start + NORMAL, min(start + MOST, n)
        end = last
        at = bisect_left(hard, start + LEAST)
        if at < len(hard) and hard[at] < normal:
            end = min(hard[at], last)
        else:
            at = bisect_left(easy, normal)
            if at < len(easy):
                end = min(easy[at], last)
        ends.append(end)
        start = end
    return ends


def chunk_set(text: str) -> set[int]:
    """Chunks as numbers: 32 bits of digest, 8 bits of length."""
    data = text.encode()
    digest = xxhash.xxh32_intdigest
    found, start = set(), 0
    for end in boundaries(data):
        found.add(digest(data[start:end]) << 8 | end - start)
        start = end
    return found


def written_out(chunks: set[int]) -> str:
    """Ten hexadecimal digits for each chunk, in order."""
    return np.array(sorted(chunks), ">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def read_in(fingerprint: str) -> set[int]:
    return {int(fingerprint[i : i + 10], 16) for i in range(0, len(fingerprint), 10)}


def containment(own: set[int], other: set[int]) -> float:
    """Share of the length of ``own`` chunks that ``other`` has too."""
    total = sum(c & 255 for c in own)
    return sum(c & 255 for c in own & other) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of another text, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _pair(doc_id: int | None, text: str, own: set[int], following: str, next_set: set[int]) -> tuple:
    changed = edited(text, following)
    changed_set = chunk_set(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        written_out(own),
        written_out(changed_set),
        containment(own, changed_set),
        containment(own, next_set),
    )


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows: (range, guest, doc_id, text) by range, guests last. Each row but guests goes with the row behind it."""
    held = None
    for place, guest, doc_id, text in rows:
        if held is not None and held[0] == place:
            chunks = held[3] if held[2] == text else chunk_set(text)
            yield _pair(held[1], held[2], held[3], text, chunks)
        else:
            chunks = chunk_set(text)
        held = None if guest else (place, doc_id, text, chunks)


def with_next(docs: DataFrame) -> DataFrame:
    """``PAIRED`` for every document: its fingerprint, that of its edited text, and likeness to that and to the
    next document by descending id. Texts are shuffled once."""
    arrow_ready(docs.sparkSession)
    rows = keyed(docs)
    heads = range_heads(rows, descending=True)
    n = max(1, len(heads))
    # The first row of a range, which its key tells from all others, goes to the range before too.
    firsts = rows.sparkSession.createDataFrame(heads or [(0, "", 0, 0)], "o_at long, o_head string, o_hash long, o_read long")
    first = rows.join(F.broadcast(firsts.withColumn("first", F.lit(True))), KEY, "left")
    own = F.struct(F.col("place"), F.lit(0).alias("guest"))
    also = F.struct(F.pmod(F.col("place") - 1, F.lit(n)).alias("place"), F.lit(1).alias("guest"))
    goes_to = F.when(F.col("first"), F.array(own, also)).otherwise(F.array(own))
    ordered = (
        in_ranges(first, heads, descending=True)
        .select("doc_id", "text", *KEY, F.inline(goes_to))
        .repartitionById(n, "place")
        .sortWithinPartitions("place", "guest", *directed(descending=True))
        .select("place", "guest", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)])
        )
        made: list[tuple] = []
        size = 0
        for pair in _pairs(rows):
            made.append(pair)
            size += len(pair[3]) + len(pair[4])
            if size > 1 << 21:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)

    return ordered.mapInArrow(run, PAIRED)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
    return pa.RecordBatch.from_arrays(columns, names=PAIRED.names)
