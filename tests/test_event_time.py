"""Streams with event time: bounded state, late rows, joins that end, timers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcloom.operators import retries
from srcloom.plans.catalog import CATALOG
from srcloom.streaming import streams

START = "timestamp '2024-01-01 00:00:00'"


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def file_after_file(spark, folder, parts):
    """Files with ascending times of change, one for each batch."""
    import glob
    import os

    for number, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        newest = max(glob.glob(f"{folder}/*.parquet"), key=os.path.getctime)
        os.utime(newest, (1_700_000_000 + number, 1_700_000_000 + number))
    return streams.file_stream(spark, folder, max_files=1)


def test_state_of_a_hundred_batches_is_bounded(few_partitions, tmp_path):
    """Ten new keys and ten of the batch before in each hourly batch, and a null key; keys live for three hours."""
    spark = few_partitions
    every = spark.range(100 * 21).selectExpr(
        "id div 21 as batch",
        "case when id % 21 = 20 then null when id % 21 < 10 then concat('k', id div 21 - 1, '-', id % 21) else concat('k', id div 21, '-', id % 21 - 10) end as hash",
        f"{START} + make_dt_interval(0, cast(id div 21 as int), 0, id % 21) as ts",
    )
    rows = spark.createDataFrame(every.collect(), every.schema)
    stream = file_after_file(spark, str(tmp_path / "in"), [rows.where(F.col("batch") == b) for b in range(100)])
    sink = str(tmp_path / "out")
    done = streams.dedup_into(stream, "hash", "ts", sink, str(tmp_path / "log"), "3 hours")
    found = spark.read.parquet(sink)
    assert done.batches >= 100 and done.late_rows == 0
    # Two levels of at most four or five batches of keys.
    assert 0 < done.state_rows <= 2 * 6 * 21
    assert found.where("hash is not null").count() == found.select("hash").distinct().count() - 1 == 100 * 10 + 10
    # The null key comes anew when the watermark, three hours behind, is three hours past its row.
    assert 12 <= found.where("hash is null").count() <= 100 // 6


def test_null_key_once_and_late_rows_counted(few_partitions, tmp_path):
    spark = few_partitions

    def part(rows):
        return spark.createDataFrame(rows, "hash string, day int, other string").selectExpr(
            "hash", f"{START} + make_dt_interval(day) as ts", "other"
        )

    parts = [
        part([(None, 0, "x"), (None, 1, "y"), ("a", 0, "x"), ("a", 0, "x")]),
        part([(None, 2, "z"), ("b", 100, "x")]),
        # A watermark judges late rows from the second batch after its row on.
        part([("b", 100, "y")]),
        part([("late", 1, "x"), ("a", 101, "x"), ("b", 99, "y")]),
    ]
    stream = file_after_file(spark, str(tmp_path / "in"), parts)
    sink = str(tmp_path / "out")
    done = streams.dedup_into(stream, "hash", "ts", sink, str(tmp_path / "log"), "30 days")
    rows = sorted((r.hash or "") for r in spark.read.parquet(sink).collect())
    assert rows == ["", "a", "a", "b"] and done.late_rows == 1
    assert spark.read.parquet(sink).columns == ["hash", "ts", "other"]


PROMPTS = [(i, i * 20) for i in range(60)] + [(None, 30)]
REPLIES = [(i, i * 20 + wait, f"r{i}") for i, wait in zip(range(60), [0, 50, 299, 300, 301, 900, -5] * 9) if i % 11]
REPLIES += [(5, 5 * 20 + 10, "second"), (5, 5 * 20 + 11, "third"), (None, 40, "null"), (999, 50, "unknown")]


@pytest.mark.parametrize("batches", [1, 4])
def test_replies_in_time_equal_the_batch_join(few_partitions, tmp_path, batches):
    spark = few_partitions
    moment = f"{START} + make_dt_interval(0, 0, 0, at) as {{}}"
    prompts = spark.createDataFrame(PROMPTS, "chunk_id int, at int").selectExpr("chunk_id", moment.format("sent"), "at")
    replies = spark.createDataFrame(REPLIES, "chunk_id int, at int, raw string").selectExpr("chunk_id", moment.format("received"), "raw", "at")

    def in_batches(rows, name, width):
        cut = [rows.where((F.col("at") >= b * width) & (F.col("at") < (b + 1) * width if b < batches - 1 else F.lit(True))) for b in range(batches)]
        first = rows.where("at < 0")
        end = rows.limit(1).select(
            *[
                (F.lit("2100-01-01").cast("timestamp") if c in ("sent", "received") else F.lit(-1 if c == "chunk_id" else None)).cast(t).alias(c)
                for c, t in rows.dtypes
            ]
        )
        parts = [cut[0].unionAll(first), *cut[1:]]
        if batches == 1:
            stream = file_after_file(spark, str(tmp_path / name), parts)
            time = "sent" if "sent" in rows.columns else "received"
            return streams.closed(stream, **{time: "2100-01-01", "chunk_id": -1}).drop("at")
        return file_after_file(spark, str(tmp_path / name), [*parts, end]).drop("at")

    met = streams.with_replies(
        in_batches(prompts, "prompts", 400),
        in_batches(replies, "replies", 400),
        "chunk_id",
        "sent",
        "received",
        delay="1 hour",
    ).where("sent < timestamp '2099-01-01'")
    sink = str(tmp_path / "out")
    done = streams.run_counted(met, sink, str(tmp_path / "log"))
    found = sorted(spark.read.parquet(sink).select("chunk_id", "raw", "replied").collect(), key=repr)
    within = (F.col("r.chunk_id") == F.col("p.chunk_id")) & F.expr("r.at between p.at and p.at + 300")
    wanted = prompts.alias("p").join(replies.alias("r"), within, "left").selectExpr("p.chunk_id", "r.raw", "r.raw is not null as replied")
    assert found == sorted(wanted.collect(), key=repr) and done.late_rows == 0
    # What is over has left the state: the two closing rows stay.
    assert sum(not r.replied for r in found) > 10


def tries(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, outcome string, at int").selectExpr(
        "chunk_id", "outcome", f"{START} + make_dt_interval(0, 0, 0, at) as ts"
    )


TRIES = [
    (1, "transient", 0), (1, "transient", 10), (1, "success", 20),
    (2, "transient", 0), (2, "transient", 1), (2, "transient", 3), (2, "transient", 7), (2, "transient", 15),
    (3, "transient", 5),
    (4, "started", 1),
    (5, "transient", 0), (5, "transient", 200), (5, "transient", 290),
    (6, "success", 3),
    (None, "transient", 3),
]


@pytest.mark.parametrize("cuts", [[1000], [8, 1000], [2, 4, 12, 250, 1000]])
def test_running_tries_equal_the_summary(few_partitions, tmp_path, cuts):
    spark = few_partitions
    log = tries(spark, TRIES)
    bounds = [-1, *cuts]
    parts = [tries(spark, [t for t in TRIES if a < t[2] <= b]) for a, b in zip(bounds, bounds[1:])]
    stream = file_after_file(spark, str(tmp_path / "in"), parts)
    sink = str(tmp_path / "out")
    # No watermark passes the timers, so all that counts are the rows.
    streams.run_counted(streams.retry_states(stream, delay="1 hour"), sink, str(tmp_path / "log"))
    states = spark.read.parquet(sink).collect()
    last = {}
    for r in sorted(states, key=lambda r: (r.failures, r.elapsed_seconds, r.succeeded)):
        last[r.chunk_id] = r
    summary = {r.chunk_id: r for r in retries.attempt_summary(log).collect() if r.chunk_id is not None}
    queue = {r.chunk_id: r.next_wait_seconds for r in retries.retry_queue(log).collect()}
    assert set(last) == set(summary)
    for chunk, r in summary.items():
        got = last[chunk]
        assert (got.failures, got.succeeded, got.elapsed_seconds, got.gave_up) == (r.failures, r.succeeded, r.elapsed_seconds, r.gave_up)
        assert got.next_wait_seconds == queue.get(chunk)


def test_given_up_on_time_without_a_further_row(few_partitions, tmp_path):
    spark = few_partitions
    parts = [tries(spark, [(3, "transient", 5), (6, "success", 3), (4, "started", 1)]), tries(spark, [(7, "started", 1000)]), tries(spark, [(8, "started", 1001)])]
    stream = file_after_file(spark, str(tmp_path / "in"), parts)
    sink = str(tmp_path / "out")
    done = streams.run_counted(streams.retry_states(stream), sink, str(tmp_path / "log"))
    rows = spark.read.parquet(sink).where("chunk_id = 3").orderBy("gave_up").collect()
    assert [(r.failures, r.gave_up, r.next_wait_seconds) for r in rows] == [(1, False, 1.0), (1, True, None)]
    assert {r.chunk_id for r in spark.read.parquet(sink).where("gave_up").collect()} == {3}
    assert done.late_rows == 0


def test_chunks_share_states(few_partitions, tmp_path):
    """More chunks than buckets: a state holds many, and each has the row that the summary gives it."""
    spark = few_partitions
    outcomes = ["transient", "in flight", "transient", "success", None]
    log = tries(spark, [(c, outcomes[(c + t * t) % 5], c % 50 + 40 * t * (c % 4)) for c in range(3000) for t in range(3)])
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    states = streams.retry_states(streams.file_stream(spark, str(tmp_path / "in")), max_wait=200, delay="1 hour")
    done = streams.run_counted(states, sink, str(tmp_path / "log"))
    assert 0 < done.state_rows <= streams.TRY_BUCKETS < 3000 and done.late_rows == 0
    columns = ["chunk_id", "failures", "elapsed_seconds", "gave_up"]
    found, wanted = spark.read.parquet(sink), retries.attempt_summary(log, max_wait=200)
    assert sorted(found.select(columns).collect()) == sorted(wanted.select(columns).collect())
    waits = found.where("next_wait_seconds is not null").select(*columns[:3], "next_wait_seconds")
    assert sorted(waits.collect()) == sorted(retries.retry_queue(log, max_wait=200).collect())


@pytest.mark.parametrize("kind", ["chunk_id", "concat('c', chunk_id)", "array(chunk_id, null)"])
def test_timers_end_in_a_bucket_with_new_rows(few_partitions, tmp_path, kind):
    """Chunk 1 is given up when the watermark, the newest row before the batch, is beyond its timer at 300 seconds."""
    spark = few_partitions
    parts = [tries(spark, [row]).withColumn("chunk_id", F.expr(kind)) for row in [(1, "transient", 0), (3, "in flight", 300), (3, None, 301), (3, "in flight", 302)]]
    stream = file_after_file(spark, str(tmp_path / "in"), parts)
    told = []

    def save(batch, number):
        told.extend((number, r.failures, r.gave_up) for r in batch.orderBy(F.desc("failures")).collect())

    writer = streams.retry_states(stream, buckets=1).writeStream.option("checkpointLocation", str(tmp_path / "log"))
    writer.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    assert told == [(0, 1, False), (1, 0, False), (2, 0, False), (3, 1, True), (3, 0, False)]


def test_no_timer_runs_at_the_end_of_the_query(spark, tmp_path):
    """What fails in the last hour is given up too; the row that closes the stream is no chunk."""
    types = ["error", "view", "click", "signup", "error", "purchase", "error", "error"]
    events = spark.range(40).selectExpr(
        "id as event_id", f"{START} + make_dt_interval(0, 0, 0, id * 97) as ts", f"array({', '.join(map(repr, types))})[id % 8] as event_type"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = CATALOG["stream_retries"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(c, 3 if c % 2 else 1, c % 2 == 1, 3 * 97, c % 2 == 0) for c in range(10)}
