"""Positions and running totals over a whole table in a given order.

A window without partitions would pass the table through one task. Here the table is
range-partitioned and sorted, numbered within its partitions, and shifted by the totals of
the partitions before, which are as few as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from srcloom.session import checkpointed, ship_package, written


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Sorted rows with partition number and row number within the partition.

    Sampling the range bounds reads the input once more, so what leads to it is written first. Bounds are sampled
    anew in each run, so the result is checkpointed before its partition numbers are used twice.
    """
    ranged = written(df, "to-order").repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = F.monotonically_increasing_id()
    part = F.shiftright(row_id, 33)
    return checkpointed(
        ranged.withColumn("_part", part).withColumn("_row", row_id - F.shiftleft(part, 33) + 1)
    )


def _offsets(ranged: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Totals of all partitions before each partition: one row per partition."""
    totals = ranged.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    # One window over one row per partition of the sort, not over the table.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), zero).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), zero).alias(f"_before_{n}") for n in sums],
    )


def with_global_position(
    df: DataFrame, order: list[str], sums: dict[str, str] | None = None, name: str = "position"
) -> DataFrame:
    """Add ``name`` (from 1) in the total order ``order`` and, for each entry of ``sums``
    (new column -> summed column), the running total up to and with the row.
    """
    sums = sums or {}
    ranged = _ranged(df, order)
    # Bounded by the number of sort partitions.
    located = ranged.join(F.broadcast(_offsets(ranged, sums)), "_part")
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return located.select(
        *df.columns,
        (F.col("_before") + F.col("_row")).alias(name),
        *[(F.col(f"_before_{n}") + F.sum(c).over(upto)).alias(n) for n, c in sums.items()],
    )


@dataclass(frozen=True)
class Carry:
    """What the requests of earlier batches leave to those of the next: how many they were, what they cost, and the
    last window and slot in use."""

    position: int = 0
    spent: int = 0
    window: int = -1
    slot: int = -1


def rate_slots(
    requests: DataFrame,
    order: list[str],
    tokens: str,
    requests_per_minute: int = 500,
    tokens_per_minute: int = 10000,
) -> DataFrame:
    """Add ``position``, ``slot``, the minute from 0 in which each request may be sent under both limits, in the given
    order, and ``over_limit`` for a request that is larger than a minute's tokens by itself."""
    return next_rate_slots(requests, order, tokens, Carry(), requests_per_minute, tokens_per_minute)[0]


def next_rate_slots(
    requests: DataFrame,
    order: list[str],
    tokens: str,
    carry: Carry,
    requests_per_minute: int = 500,
    tokens_per_minute: int = 10000,
) -> tuple[DataFrame, Carry]:
    """``rate_slots`` for requests that come after those of ``carry``, and the carry of both. Any cut of an order into
    batches gives the slots of one.

    A request costs the greater of its shares of the two limits, in whole numbers with the product of the limits as
    a minute's capacity. Running costs cut the order into windows of that capacity. Requests that fit into
    their window share a slot; the one that crosses its end, at most one and the last to start, has the slot behind. So the
    sums of a slot keep both limits. Windows ascend with the order, so slots without gaps are a running count of their
    changes: after one range sort, each partition's costs and then its changes of windows are summed, and the driver adds
    up what goes before each partition. These are two small jobs over numbers when the plan is built.
    """
    spark = requests.sparkSession
    ship_package(spark)
    capacity = requests_per_minute * tokens_per_minute
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint") * requests_per_minute, F.lit(tokens_per_minute).cast("bigint"))
    names = requests.columns
    priced = requests.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], cost.alias("cost"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    ranged = priced.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    part = F.shiftright(F.monotonically_increasing_id(), 33).cast("int")
    ranged = checkpointed(ranged.withColumn("part", part))

    def windows(batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches with the windows of their rows."""
        spent = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cost").to_numpy()
            if spent is None:
                spent = before[batch.column("part")[0].as_py()]
            begins = spent + np.cumsum(own) - own
            spent = int(begins[-1] + own[-1])
            yield batch, 2 * (begins // capacity) + (begins % capacity + own > capacity)

    sums = sorted((r["part"], r["n"], r["spent"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("cost").alias("spent")).collect())
    before, rows, spent, position = {}, {}, carry.spent, carry.position
    for p, n, total in sums:
        before[p], rows[p] = spent, position
        spent, position = spent + total, position + n

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first, last, changes = None, None, None, 0
        for batch, found in windows(batches, before):
            if first is None:
                p, first, last = batch.column("part")[0].as_py(), int(found[0]), int(found[0])
            changes += int(np.count_nonzero(np.diff(found, prepend=last)))
            last = int(found[-1])
        if p is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (p, first, last, changes)], names=["part", "first", "last", "changes"])

    edges = ranged.select("part", "cost").mapInArrow(ends, "part long, first long, last long, changes long").collect()
    starts, slot, window = {}, carry.slot, carry.window
    for p, first, last, changes in sorted(map(tuple, edges)):
        slot += first != window
        starts[p] = slot
        slot, window = slot + changes, last

    schema = StructType([*ranged.schema.fields[: len(names)], StructField("position", LongType()), StructField("slot", LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = now = last = None
        for batch, found in windows(batches, before):
            if place is None:
                p = batch.column("part")[0].as_py()
                place, now, last = rows[p], starts[p], int(found[0])
            slots = now + np.cumsum(np.diff(found, prepend=last) != 0)
            positions = np.arange(place + 1, place + 1 + len(found))
            place, now, last = place + len(found), int(slots[-1]), int(found[-1])
            columns = [*batch.columns[: len(names)], pa.array(positions), pa.array(slots)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = ranged.mapInArrow(numbered, schema).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "position", "slot"
    )
    over = F.col(tokens) > tokens_per_minute
    return placed.withColumn("over_limit", over), Carry(position, spent, window, slot)


def with_neighbours(rows: DataFrame, group: str, order: list[str], tail: Column, head: Column) -> DataFrame:
    """Add ``before``, the ``tail`` of the row before within the group, and ``after``, the ``head`` of the row behind it;
    null at a group's ends. ``tail`` and ``head`` are texts.

    The table is sorted by group and order over ranges, so a group of any size is spread over tasks. Within a range rows see
    their neighbours as they pass; across ranges the first head and last tail of each, as many as there are ranges, come
    from a small job when the plan is built.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names, keys = rows.columns, ["g", *[f"o{i}" for i in range(len(order))]]
    keyed = rows.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)],
        F.col(group).alias("g"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        tail.cast("string").alias("t"),
        head.cast("string").alias("h"),
    )
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys[1:])
    part = F.shiftright(F.monotonically_increasing_id(), 33).cast("int")
    ranged = checkpointed(ranged.withColumn("part", part))
    edge_type = StructType([ranged.schema["part"], *[ranged.schema[c] for c in ("g", "h")], StructField("g2", ranged.schema["g"].dataType), ranged.schema["t"]])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or [batch.column(c).slice(0, 1) for c in ("part", "g", "h")]
                last = [batch.column(c).slice(batch.num_rows - 1, 1) for c in ("g", "t")]
        if first is not None:
            yield pa.RecordBatch.from_arrays([*first, *last], names=edge_type.names)

    edges = sorted(ranged.select("part", "g", "h", "t").mapInArrow(ends, edge_type).collect(), key=lambda r: r["part"])
    left = {b["part"]: (a["g2"], a["t"]) for a, b in zip(edges, edges[1:])}
    right = {a["part"]: (b["g"], b["h"]) for a, b in zip(edges, edges[1:])}
    schema = StructType([*ranged.schema.fields[: len(names)], StructField("before", StringType()), StructField("after", StringType())])

    def joined(batch: pa.RecordBatch, previous: tuple | None, following: tuple | None) -> pa.RecordBatch:
        g, t, h = (batch.column(c).to_pylist() for c in ("g", "t", "h"))
        fronts = [previous, *zip(g, t)]
        backs = [*list(zip(g, h))[1:], following]
        before = [p[1] if p is not None and p[0] == own else None for p, own in zip(fronts, g)]
        after = [p[1] if p is not None and p[0] == own else None for p, own in zip(backs, g)]
        columns = [*batch.columns[: len(names)], pa.array(before, pa.string()), pa.array(after, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, previous, p = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                p = batch.column("part")[0].as_py()
                previous = left.get(p)
            else:
                yield joined(held, previous, (batch.column("g")[0].as_py(), batch.column("h")[0].as_py()))
                previous = (held.column("g")[-1].as_py(), held.column("t")[-1].as_py())
            held = batch
        if held is not None:
            yield joined(held, previous, right.get(p))

    found = ranged.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "before", "after")
