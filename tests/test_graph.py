"""Reach over calls against a plain breadth-first walk."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from srcloom.operators import graph


def plain(edges, starts):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = {s: 0 for s in starts}
    queue = deque(starts)
    while queue:
        a = queue.popleft()
        for b in after.get(a, ()):
            if b not in found:
                found[b] = found[a] + 1
                queue.append(b)
    return found


def reached(spark, edges, starts):
    table = spark.createDataFrame(edges, "caller string, callee string")
    rows = graph.reached(table, spark.createDataFrame([(s,) for s in starts], "name string")).collect()
    assert len(rows) == len({r.name for r in rows})
    return {r.name: r.steps for r in rows}


def test_chain_of_a_thousand_calls(spark):
    edges = [(f"f{i}", f"f{i + 1}") for i in range(1000)] + [("f500", "side"), ("side", "f2"), ("f0", "f0")]
    assert reached(spark, edges, ["f0"]) == plain(edges, ["f0"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_with_cycles_chains_and_a_hub(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(120)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(rng.choice(names), "c0"), ("c40", rng.choice(names)), ("c17", "n3")]
    edges += [("hub", rng.choice(names)) for _ in range(60)] + [(rng.choice(names), "hub") for _ in range(10)]
    edges += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("lone", "loner")]
    edges += edges[:20]
    starts = [rng.choice(names), "c5", "nowhere"]
    assert reached(spark, edges, starts) == plain(edges, starts)


def test_odd_tables(spark):
    assert reached(spark, [(None, "a"), ("a", None), ("a", "b")], ["a", "a"]) == {"a": 0, "b": 1}
    assert reached(spark, [], ["a"]) == {"a": 0}
    table = spark.createDataFrame([("a", "b")], "caller string, callee string")
    assert graph.reached(table, spark.createDataFrame([], "name string")).count() == 0
    # What depends on a function: the edges turned round.
    turned = table.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    rows = graph.reached(turned, spark.createDataFrame([("b",)], "name string")).collect()
    assert {(r.name, r.steps) for r in rows} == {("b", 0), ("a", 1)}
