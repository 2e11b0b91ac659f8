"""Slots under rate limits against a plain loop, in one batch and in several."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from srcloom.operators import ordering
from srcloom.streaming import streams


def plain(sizes, requests=500, tokens=10000):
    capacity, spent, found, slot, last = requests * tokens, 0, [], -1, None
    for place, size in enumerate(sizes, 1):
        cost = max((size or 0) * requests, tokens)
        window = 2 * (spent // capacity) + (spent % capacity + cost > capacity)
        spent += cost
        slot += window != last
        last = window
        found.append((place, slot))
    return found


def sizes_of(seed, n):
    rng = random.Random(seed)
    return [rng.choice([None, 0, 1, 20, 300, 4000, 9999, 10000, 25_000]) if rng.random() < 0.3 else rng.randint(0, 60) for _ in range(n)]


@pytest.mark.parametrize("limits", [(500, 10000), (3, 100)])
def test_one_pass_equals_the_loop(spark, limits):
    sizes = sizes_of(1, 3000)
    rows = spark.createDataFrame(list(enumerate(sizes)), "i int, tokens long").repartition(7, "tokens")
    placed = ordering.rate_slots(rows, ["i"], "tokens", *limits).orderBy("i").collect()
    assert [(r.position, r.slot) for r in placed] == plain(sizes, *limits)
    assert ordering.rate_slots(rows.limit(0), ["i"], "tokens").collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_any_cut_into_batches_gives_the_slots_of_one(spark, seed):
    sizes, rng = sizes_of(seed, 800), random.Random(seed)
    rows = spark.createDataFrame(list(enumerate(sizes)), "i int, tokens long")
    cuts = [0, *sorted(rng.sample(range(1, 800), 4)), 800]
    carry, found = ordering.Carry(), []
    for low, high in zip(cuts, cuts[1:]):
        part, carry = ordering.next_rate_slots(rows.where((F.col("i") >= low) & (F.col("i") < high)), ["i"], "tokens", carry)
        found += part.orderBy("i").collect()
    assert [(r.position, r.slot) for r in found] == plain(sizes)
    same, after = ordering.next_rate_slots(rows.limit(0), ["i"], "tokens", carry)
    assert after == carry and same.count() == 0


def test_stream_of_requests_and_a_repeated_batch(spark, tmp_path):
    sizes = sizes_of(5, 300)
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for low, high in ((0, 90), (90, 100), (100, 300)):
        rows = [(i, s) for i, s in enumerate(sizes) if low <= i < high]
        spark.createDataFrame(rows, "i int, tokens long").coalesce(1).write.mode("append").parquet(source)
        streams.rate_slots_into(streams.file_stream(spark, source), ["i"], "tokens", sink, log)
    wanted = plain(sizes)

    def stored():
        return [(r.position, r.slot) for r in spark.read.parquet(f"{sink}/rows").orderBy("i").collect()]

    assert stored() == wanted
    # A batch whose commit was lost runs again, from the carry of the one before.
    (tmp_path / "log" / "commits" / "2").unlink()
    (tmp_path / "log" / "commits" / ".2.crc").unlink(missing_ok=True)
    streams.rate_slots_into(streams.file_stream(spark, source), ["i"], "tokens", sink, log)
    assert stored() == wanted
