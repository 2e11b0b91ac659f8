"""File streams into append, deduplicated, joined and running tables.

Event-time state is bounded by watermarks: rows later than the watermark are dropped and counted, and what cannot be
met any more leaves the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from srcloom.operators.ordering import Carry, next_rate_slots
from srcloom.operators.retries import EXPONENTIAL_BASE, MAX_ATTEMPTS, MAX_WAIT_SECONDS
from srcloom.session import new_folder, ship_package
from srcloom.sources.sinks import CSV

TTL = "30 days"
REPLY_LIMIT, REPLY_DELAY = "300 seconds", "60 seconds"
# Groups in which a key's copies are reduced before they meet; batches whose progress is kept.
SALTS, KEPT_PROGRESS = 64, 10_000
# Groups of chunks whose tries are followed together.
TRY_BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of Parquet files at a path or glob; the schema comes from the files' footers."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun with the same checkpoint adds only new input.

    The file sink commits whole batches, so a failed or repeated run leaves no row twice.
    State too large for the heap is kept in RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer.format("parquet").option("path", sink).trigger(availableNow=True).start().awaitTermination()


def append_results(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a row-wise transform over a stream into a new table and read that table."""
    spark = stream.sparkSession
    sink = new_folder(spark, "append")
    run_available(transform(stream), sink, new_folder(spark, "append-log"))
    return spark.read.parquet(sink)


@dataclass(frozen=True)
class Progress:
    """Of a run: batches, rows later than the watermark, and the largest state of any batch."""

    batches: int
    late_rows: int
    state_rows: int
    state_bytes: int


def run_counted(stream: DataFrame, sink: str, checkpoint: str) -> Progress:
    """``run_available`` in append mode, with what the state did; all batches of the run count."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(KEPT_PROGRESS))
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    query = writer.format("parquet").option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [json.loads(p.json)["stateOperators"] for p in query.recentProgress]
    return Progress(
        len(states),
        sum(o["numRowsDroppedByWatermark"] for batch in states for o in batch),
        max((sum(o["numRowsTotal"] for o in batch) for batch in states), default=0),
        max((sum(o["memoryUsedBytes"] for o in batch) for batch in states), default=0),
    )


def first_of_key(stream: DataFrame, key: str, ts: str, ttl: str = TTL) -> DataFrame:
    """One row of each key; a key counts anew once the watermark, ``ttl`` behind the newest row, has passed its first row.

    Null keys are one key. A key's rows are first reduced within ``SALTS`` groups by where they were read, so that one with a
    third of all rows does not meet in a single task.
    """
    at = F.col(ts).cast("timestamp").alias("event_time")
    salted = stream.select("*", at, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    marked = salted.withWatermark("event_time", ttl)
    once = marked.dropDuplicatesWithinWatermark([key, "salt"]).dropDuplicatesWithinWatermark([key])
    return once.select(*stream.columns)


def dedup_into(stream: DataFrame, key: str, ts: str, sink: str, checkpoint: str, ttl: str = TTL) -> Progress:
    """Append ``first_of_key`` to a table. The state is all that is kept of earlier batches."""
    return run_counted(first_of_key(stream, key, ts, ttl), sink, checkpoint)


def dedup_results(stream: DataFrame, key: str, ts: str, ttl: str = TTL) -> DataFrame:
    spark = stream.sparkSession
    sink = new_folder(spark, "dedup")
    dedup_into(stream, key, ts, sink, new_folder(spark, "dedup-log"), ttl)
    return spark.read.parquet(sink)


def closed(stream: DataFrame, **values: object) -> DataFrame:
    """A stream that is read in one batch with one more row of the given values, null elsewhere, whose time moves the
    watermark behind all others; in more batches such a row belongs into the last file. It needs whatever filters ask for that Spark may move in front of the watermark, such as a key that is
    not null; take it out by its time, by which no filter moves."""
    spark = stream.sparkSession
    folder = new_folder(spark, "closing")
    row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def with_replies(
    prompts: DataFrame,
    replies: DataFrame,
    key: str,
    sent: str,
    received: str,
    limit: str = REPLY_LIMIT,
    delay: str = REPLY_DELAY,
) -> DataFrame:
    """Prompts with the replies that came within ``limit`` of being sent, and ``replied``; a prompt without one
    comes out with nulls when the watermark has passed its limit.

    Both streams hold rows of their own for as long as a partner may come and no longer. ``delay`` is how
    late a row may be behind the newest of its stream. Prompts with a null key have no reply.
    """
    own = prompts.withWatermark(sent, delay)
    others = replies.withColumnRenamed(key, "reply_key").withWatermark(received, delay)
    within = (
        (F.col(key) == F.col("reply_key"))
        & (F.col(received) >= F.col(sent))
        & (F.col(received) <= F.col(sent) + F.expr(f"interval {limit}"))
    )
    met = own.join(others, within, "leftOuter")
    return met.withColumn("replied", F.col("reply_key").isNotNull()).drop("reply_key")


ATTEMPT_STATE = "tries binary"
ATTEMPT_ROW = "failures int, succeeded boolean, elapsed_seconds long, gave_up boolean, next_wait_seconds double"
# What is kept of a chunk's tries, and how it is put together.
KEPT_TRIES = {"failures": "sum", "succeeded": "any", "first_at": "min", "last_at": "max", "fresh": "any"}


def _by_chunk(tries: pa.Table) -> pa.Table:
    """One row of each chunk. Arrow groups by plain values only, so ids with parts meet by how they are written."""
    ids = tries["chunk_id"]
    names = pa.array(map(repr, ids.to_pylist()), "string") if pa.types.is_nested(ids.type) else ids
    named = tries.set_column(0, "name", names).append_column("place", pa.array(np.arange(len(ids))))
    met = named.group_by("name", use_threads=False).aggregate([("place", "min"), *KEPT_TRIES.items()])
    return pa.table([ids.take(met["place_min"]), *[met[f"{c}_{how}"] for c, how in KEPT_TRIES.items()]], ["chunk_id", *KEPT_TRIES])


def _packed(tries: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tries.schema) as out:
        out.write_table(tries)
    return sink.getvalue().to_pybytes()


def retry_states(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    max_wait: int = MAX_WAIT_SECONDS,
    base: int = EXPONENTIAL_BASE,
    delay: str = "0 seconds",
    buckets: int = TRY_BUCKETS,
) -> DataFrame:
    """Tries of each chunk as they come in: (chunk_id, failures, succeeded, elapsed_seconds, gave_up, next_wait_seconds),
    a row whenever a chunk has new ones.

    A chunk has a timer at its first try plus ``max_wait``. If it has failed and not succeeded by then it is given
    up, whether or not a further row comes; its state goes, as that of a chunk that succeeded or failed too often does when its
    timer ends.

    Chunks are followed in ``buckets`` by a hash of their id, as a call of Python for each costs more than its rows: a state is a
    small Arrow table of a bucket's chunks whose timers run, and its timer the first of theirs. A checkpoint belongs to one number
    of buckets.
    """
    ship_package(attempts.sparkSession)
    kind = attempts.schema["chunk_id"].dataType
    fields = [StructField("chunk_id", kind)]
    schema = StructType([*fields, *StructType.fromDDL(ATTEMPT_ROW).fields])
    # Pandas holds times without their zone.
    stored = to_arrow_type(TimestampNTZType() if isinstance(kind, TimestampType) else kind)
    marked = attempts.where(F.col("chunk_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).alias("bucket"),
        "chunk_id",
        F.coalesce(F.col("outcome") == "transient", F.lit(False)).alias("failed"),
        F.coalesce(F.col("outcome") == "success", F.lit(False)).alias("succeeded"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
    )

    def rows(tries: pa.Table, over: np.ndarray) -> pd.DataFrame:
        failures, succeeded, first, last = (tries[c].to_numpy() for c in ("failures", "succeeded", "first_at", "last_at"))
        seconds = last - first
        failing = ~succeeded & (failures > 0)
        gave_up = failing & (over | (failures >= max_attempts) | (seconds >= max_wait))
        waits = failing & ~gave_up
        wait = np.full(len(seconds), np.nan)
        wait[waits] = np.minimum(float(base) ** (failures[waits] - 1), max_wait - seconds[waits])
        return pd.DataFrame(dict(zip(schema.names, (tries["chunk_id"].to_pandas(), failures, succeeded, seconds, gave_up, wait))))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        for batch in () if state.hasTimedOut else batches:
            at = pa.array(batch["at"])
            columns = (pa.array(batch["chunk_id"], stored, from_pandas=True), pa.array(batch["failed"].astype("int64")), pa.array(batch["succeeded"]), at, at)
            known.append(_by_chunk(pa.table([*columns, pa.repeat(True, len(batch))], ["chunk_id", *KEPT_TRIES])))
        tries = _by_chunk(pa.concat_tables(known))
        fresh, now = tries["fresh"].to_numpy(), state.getCurrentWatermarkMs()
        end = (tries["first_at"].to_numpy() + max_wait) * 1000
        # A timer ends when the watermark is beyond it; a chunk with new rows is judged at once.
        over = (end < now) | (fresh & (end == now))
        runs = tries.filter(pa.array(~over)).set_column(5, "fresh", pa.repeat(False, int((~over).sum())))
        if runs.num_rows:
            state.update((_packed(runs),))
            state.setTimeoutTimestamp(int(end[~over].min()))
        elif state.exists:
            state.remove()
        told = fresh | over
        yield rows(tries.filter(pa.array(told)), over[told])

    return (
        marked.withWatermark("ts", delay)
        .groupBy("bucket")
        .applyInPandasWithState(follow, schema, ATTEMPT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def rate_slots_into(stream: DataFrame, order: list[str], tokens: str, sink: str, checkpoint: str, **limits: int) -> None:
    """Slots of requests that arrive in batches, each behind the one before in the given order, as one batch of all
    would have them. A batch leaves its carry beside its rows, so one that is repeated starts from the same and
    overwrites itself."""
    spark = stream.sparkSession
    state = "position long, spent long, window long, slot long"

    def save(batch: DataFrame, number: int) -> None:
        own = Carry(*spark.read.schema(state).parquet(f"{sink}/carry/batch={number - 1}").first()) if number else Carry()
        placed, after = next_rate_slots(batch, order, tokens, own, **limits)
        placed.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        row = spark.createDataFrame([(after.position, after.spent, after.window, after.slot)], state)
        row.coalesce(1).write.mode("overwrite").parquet(f"{sink}/carry/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    writer.trigger(availableNow=True).start().awaitTermination()


def append_csv(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append a stream's rows to CSV files with a header each; whole batches are committed, none twice."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.format("csv").option("path", folder).options(**CSV)
    writer.trigger(availableNow=True).start().awaitTermination()


def running_counters(stream: DataFrame, by: str, counters: dict[str, str]) -> DataFrame:
    """Counters per group in update mode: each batch rewrites the groups it changed.

    Groups are few (a status, an event type); ``counters`` maps names to SQL aggregates. The
    sink keeps one folder per batch with all groups so far, so a repeated batch overwrites itself and
    the newest folder is the whole table.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    counts = stream.groupBy(by).agg(*[F.expr(sql).alias(n) for n, sql in counters.items()])
    sink = new_folder(spark, "counters")

    def save(batch: DataFrame, number: int) -> None:
        # Each folder holds the value of every group so far, so the latest one is the whole table.
        latest = batch
        if number:
            before = spark.read.parquet(f"{sink}/batch={number - 1}")
            latest = batch.unionByName(before.join(batch.select(by), before[by].eqNullSafe(batch[by]), "left_anti"))
        latest.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        newest[0] = number

    newest = [0]
    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", new_folder(spark, "counters-log"))
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{sink}/batch={newest[0]}").select(by, *counters)
