"""SimHash near-duplicates, with candidates from pigeonring filtering.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in at most t bits, some chain
of consecutive segments, wherever it starts, keeps every prefix of j segments within j * t / m
differing bits. With t = 2 and m = 5 the first two segments of such a chain are equal, three and four of
them differ in at most one bit, five in at most two. So of the third and the fourth segment one is equal too: fingerprints
meet by (start, first two segments, and the third or the fourth), 38 or 39 bits, ten rows for each fingerprint. The
chain is then checked segment by segment, and only what is left gets the full Hamming check.

By chance a bucket of that many bits holds two fingerprints where there are some 10^11. What fills one is a group of near copies. Up to
``BUCKET`` members yield their linked pairs inside one row. In a larger group no pairs are formed: two fingerprints
differ in at most two bits if and only if they share a fingerprint at distance one or less from both, so each member
names those around it, once, and a member is linked to the least one with the same neighbour. That adds no link and
loses none between components, its aggregates combine on the map side, and the group may have any size.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; rows with equal ids are separate rows with the same component rules; a null id is no
component's name: its rows get the component of their fingerprint, null if all ids there are null. An empty table
gives an empty result; texts of any length are read whole; a kept column named like one of ``OWN`` is replaced, and
``keep_one`` takes columns of any names and types.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from srcloom.llm.common import add_columns, arrow_ready, carried, quoted, returned, without
from srcloom.llm.components import components
from srcloom.operators.skew import join_unique
from srcloom.session import written

SHINGLE = 3
DISTANCE = 2
SEED = 42
BITS = 64
# Segments of the ring: first bit and number of bits.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUCKET = 16
OWN = ["fp", "group", "component_id"]
# No bit, and each single bit, as signed numbers.
FLIPS = [0, *[int(np.uint64(1 << b).astype(np.int64)) for b in range(BITS)]]
# Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8; bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _signed(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    values = [hashed(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    return _signed(np.array(values, np.uint64))


def _signed(values: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), BLOCK):
        part = values[at : at + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of every whole text as a signed 64-bit number."""
    arrow_ready(docs.sparkSession)

    def compute(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        binary = texts.cast(pa.binary())
        return [pa.array([fingerprint(t, shingle) for t in binary.to_pylist()], pa.int64())]

    return add_columns(docs, compute, [StructField(name, LongType())], keep)


def _segment(fp: Column, i: int) -> Column:
    first, bits = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def chain_holds(x: Column, y: Column, start: int, distance: int = DISTANCE) -> Column:
    """Every prefix of the chain from ``start`` within its proportional share of the distance."""
    m, spent, holds = len(SEGMENTS), F.lit(0), F.lit(True)
    for j in range(m):
        spent = spent + F.bit_count(_segment(x, start + j).bitwiseXOR(_segment(y, start + j)))
        holds = holds & (spent <= (j + 1) * distance // m)
    return holds


def buckets(fps: DataFrame) -> DataFrame:
    """(fp, start, key): two rows for each start of a chain, whose first two segments are in the key, with the third or
    the fourth, of which one is equal in every chain."""

    def key(start: int, other: int) -> Column:
        found = _segment(F.col("fp"), start)
        for place, i in enumerate((start + 1, start + other), 1):
            found = found.bitwiseOR(F.shiftleft(_segment(F.col("fp"), i), 13 * place))
        return F.struct(F.lit(start).alias("start"), found.bitwiseOR(F.lit(other << 39)).alias("key"))

    keys = [key(i, other) for i in range(len(SEGMENTS)) for other in (2, 3)]
    return fps.select("fp", F.inline(F.array(*keys)))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a < b, that join all that lie within the distance."""
    spark = fps.sparkSession
    rows = buckets(fps)
    # Sizes combine on the map side; fingerprints alone in a bucket go no further.
    sizes = rows.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, ["start", "key"]), "simhash-buckets")

    small = shared.where(F.col("n") <= BUCKET).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    x = F.col("x")

    def partners(start: int) -> Column:
        return F.transform(
            F.col("fps"),
            lambda a: F.struct(
                a.alias("a"),
                F.filter(
                    F.col("fps"),
                    lambda b: (b > a)
                    & chain_holds(a, b, start)
                    & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE),
                ).alias("bs"),
            ),
        )

    by_start = None
    for i in range(len(SEGMENTS)):
        by_start = F.when(F.col("start") == i, partners(i)) if by_start is None else by_start.when(
            F.col("start") == i, partners(i)
        )
    pairs = (
        small.select(F.explode(by_start).alias("x"))
        .where(F.size(x["bs"]) > 0)
        .select(x["a"].alias("a"), F.explode(x["bs"]).alias("b"))
    )

    # Members of large buckets, each once: the fingerprint itself and those one bit away.
    large = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(*[F.lit(f) for f in FLIPS])
    around = large.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    stars = (
        around.join(least.select("near", "a"), "near")
        .where(F.col("a") < F.col("fp"))
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The kept columns, fp, group and component_id of every row: the component is the least id that links
    reach, the group the least fingerprint."""
    prints = written(with_fingerprints(docs, without(keep, OWN), shingle=shingle), "simhash")
    return with_components(prints, doc_id)


def with_components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds groups and component ids to a table with ids and fingerprints ``fp``."""
    own = written(prints.groupBy("fp").agg(F.min(quoted(doc_id)).alias("_id"), F.count("*").alias("_n")), "simhash-own")
    labels = components(links(own.select("fp")))
    of = own.join(labels, own.fp == labels.node, "left").select(
        "fp", "_id", "_n", F.coalesce("label", "fp").alias("group"), F.col("label").isNotNull().alias("_linked")
    )
    # Fingerprints of one document without links are their own component and need no join.
    least = of.groupBy("group").agg(F.min("_id").alias("component_id"))
    grouped = of.where(F.col("_linked") | (F.col("_n") > 1)).join(least, "group").select("fp", "group", "component_id")
    return (
        join_unique(prints, grouped, "fp")
        .withColumn("component_id", F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(quoted(doc_id)))
        .withColumn("group", F.coalesce("group", "fp"))
    )


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: of the least id, and of rows with that id the least hash of the
    text, then the row that comes first as JSON.

    Which rows go is decided on ids and hashes; texts meet only the list of those.
    """
    own, names = carried(docs, ["doc_id", "text"])
    hashed = own.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    found = written(near_duplicates(hashed, ["doc_id", "hash"]), "simhash-groups")
    winners = (
        found.groupBy("group")
        .agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("doc_id", "hash"))).alias("one"), F.count("*").alias("n"))
        .where("n > 1")
    )
    lost = (
        join_unique(found, winners, "group", "inner")
        .where(~F.struct("doc_id", "hash").eqNullSafe(F.col("one")))
        .select(F.col("doc_id").alias("lost_id"), F.col("hash").alias("lost_hash"))
        .distinct()
    )
    own = own.withColumn("hash", F.xxhash64("text"))
    kept = own.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("hash") == F.col("lost_hash")), "left_anti")
    again = found.groupBy("doc_id", "hash").count().where("count > 1")
    if again.isEmpty():
        return returned(kept, docs)
    # Rows of equal id and text: one of each.
    again = again.select(F.col("doc_id").alias("again_id"), F.col("hash").alias("again_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("hash") == F.col("again_hash"))
    row = F.struct(*names)
    single = kept.join(again, same, "left_anti").select(*names)
    packed = kept.join(again, same, "left_semi").groupBy("doc_id", "hash").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return returned(single.unionAll(packed.select("row.*")), docs)
