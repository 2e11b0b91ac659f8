"""Sharding by a keyed permutation of row numbers.

Rows get global numbers in a total order (id, hash of the text, size, checksum). A Feistel network over 2h bits, the
smallest even number of bits that holds all numbers, permutes them; a result that is no row number is permuted again
until it is one (cycle walking), which keeps the whole a permutation of the row numbers. The permuted
number p gives shard p mod n and slot p div n. So shard sizes differ by one row at most, slots have no gaps,
the shuffle is the same for the same rows and seed however they are stored, and shard and slot of any row number, or the
row at any shard and slot, are computed without a table (``locate`` and ``row_at``).

Only ids, hashes and the kept columns are sorted, over many tasks: rows that agree in all of the order are told apart
by where they were read, so a group of copies of any size is split like other rows. The number of rows and the sizes
of the sort's partitions are all that the driver sees.

Defined cases: a null id stands before all others; a null text has no bytes and checksum 0; rows of equal id go by
text; rows equal in id and text are interchangeable; an empty table gives an empty result; texts may have any length;
a kept column with the name of an added one, whatever its case, is replaced, and no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from srcloom.llm.common import arrow_ready, quoted, without
from srcloom.operators.ordering import with_global_position

SHARDS = 16
SEED = 42
ROUNDS = 6
OWN = ["size", "text_crc32", "shard", "slot"]
LAW = "rows"


def _half_bits(n: int) -> int:
    """Half of the least even number of bits that holds 0 to n - 1, one at least."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """Round function: multiply and shift on 64 bits."""
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 62, ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: Sequence[int], back: bool) -> np.ndarray:
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> width, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return left << width | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Permuted numbers of row numbers 0 to n - 1, or, ``back``, the row numbers of permuted ones."""
    x = np.asarray(rows, np.uint64).copy()
    if len(x) and int(x.max()) >= n:
        raise ValueError("row number beyond the table")
    bits, keys = _half_bits(n), _keys(seed)
    at = np.arange(len(x))
    while len(at):
        x[at] = _network(x[at], bits, keys, back)
        at = at[x[at] >= np.uint64(n)]
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def with_places(
    docs: DataFrame, keep: Sequence[str], shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The kept columns with ``size`` (bytes of the text plus one), ``text_crc32``, ``shard`` and ``slot``."""
    spark = arrow_ready(docs.sparkSession)
    kept = without(keep, OWN)
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)],
        quoted(doc_id).alias("order_id"),
        F.xxhash64(whole).alias("order_hash"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read"),
    )
    numbered = with_global_position(rows, ["order_id", "order_hash", "size", "text_crc32", "read"], name="number")
    chosen = numbered.select(*[f"k{i}" for i in range(len(kept))], "size", "text_crc32", "number")
    n = chosen.count()
    schema = chosen.drop("number").schema.add(StructField("shard", IntegerType())).add(StructField("slot", LongType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column(batch.num_columns - 1).to_numpy() - 1, n, seed)
            made = [pa.array(place % shards, pa.int32()), pa.array(place // shards, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    placed = chosen.mapInArrow(run, schema)
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *OWN)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet folders ``shard=N``, whose files are runs of ascending slots."""
    placed = with_places(docs, docs.columns, shards, seed)
    ranged = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(folder)
