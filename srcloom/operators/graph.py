"""Call edges from validated replies and their resolution to known functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.operators.results import OK
from srcloom.operators.skew import join_unique
from srcloom.session import written


def call_edges(results: DataFrame) -> DataFrame:
    """Distinct (caller, callee) names from both lists of each valid reply, in one pass."""
    out = F.transform("call_graph.calls", lambda c: F.struct(F.col("chunk_name").alias("caller"), c.alias("callee")))
    back = F.transform(
        "call_graph.called_by", lambda c: F.struct(c.alias("caller"), F.col("chunk_name").alias("callee"))
    )
    edges = results.where(F.col("status") == OK).select(F.explode(F.concat(out, back)).alias("e"))
    return edges.select("e.caller", "e.callee").distinct()


def definitions(functions: DataFrame) -> DataFrame:
    """One row per function name: how often it is defined and where first."""
    return functions.groupBy("name").agg(
        F.count("*").alias("definitions"), F.min(F.struct("file_path", "start_line")).alias("first")
    )


def resolve_calls(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges with the definition of the callee; calls to unknown functions are kept.

    Names are reduced to one row each before the join: a name defined in many files and
    called from many would otherwise pair all its rows.
    """
    known = definitions(functions)
    callee = known.select(F.col("name").alias("callee"), "definitions", "first")
    caller = known.select(F.col("name").alias("caller"), F.lit(True).alias("known"))
    joined = join_unique(join_unique(edges, callee, "callee"), caller, "caller")
    return joined.select(
        "caller",
        "callee",
        F.coalesce("definitions", F.lit(0).cast("bigint")).alias("definitions"),
        F.col("first.file_path").alias("callee_file"),
        F.col("first.start_line").alias("callee_line"),
        F.col("definitions").isNotNull().alias("resolved"),
        F.coalesce("known", F.lit(False)).alias("caller_known"),
    )


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(name, steps): the functions that calls lead to from any of ``starts`` (name), with the least number of calls; a
    start has 0. Edges are (caller, callee); turned round they give what depends on the starts.

    Names with one caller and one callee are links of chains. These are shortened first, by pointer jumping, which takes as
    many rounds as the logarithm of the longest chain has; what is left are weighted edges between the other names.
    From the starts, a frontier of improved names then meets its edges until nothing improves. Cycles need no care: no
    name improves by going round. Each round is written to the shared folder; joins are on names that are
    unique on one side and split where a name has many edges, and the least is taken on the map side first. No task
    holds more of the graph than its share of names.
    """
    plain = edges.where("caller IS NOT NULL AND callee IS NOT NULL AND caller <> callee").select("caller", "callee").distinct()
    calls = written(plain, "calls")
    entry = written(starts.where("name IS NOT NULL").select("name").distinct(), "starts")
    one = F.lit(1).cast("long")
    ends = calls.select(F.col("callee").alias("name"), F.col("caller").alias("head"), one.alias("ins"), F.lit(0).cast("long").alias("outs")).unionAll(
        calls.select("caller", F.lit(None).cast(calls.schema["caller"].dataType), F.lit(0).cast("long"), one)
    )
    degrees = ends.groupBy("name").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("head").alias("head"))
    links = degrees.where("ins = 1 AND outs = 1").join(entry, "name", "left_anti").select("name", "head", one.alias("offset"))
    links = _jumped(written(links, "links"))

    short = links.select(F.col("name").alias("caller"), "head", "offset")
    inner = links.select(F.col("name").alias("callee"))
    weighted = join_unique(join_unique(calls, inner, "callee", "left_anti"), short, "caller").select(
        F.coalesce("head", "caller").alias("caller"), "callee", (F.coalesce("offset", F.lit(0)) + 1).alias("weight")
    )
    weighted = written(weighted.groupBy("caller", "callee").agg(F.min("weight").alias("weight")), "weighted-calls")

    known = entry.select("name", F.lit(0).cast("long").alias("steps"))
    frontier = known
    while True:
        near = join_unique(weighted, frontier.select(F.col("name").alias("caller"), "steps"), "caller", "inner")
        offered = near.groupBy(F.col("callee").alias("name")).agg(F.min(F.col("steps") + F.col("weight")).alias("offer"))
        merged = written(
            known.join(offered, "name", "full_outer").select(
                "name",
                F.least("steps", "offer").alias("steps"),
                (F.col("offer").isNotNull() & (F.col("steps").isNull() | (F.col("offer") < F.col("steps")))).alias("better"),
            ),
            "reached",
        )
        known, frontier = merged.select("name", "steps"), merged.where("better").select("name", "steps")
        if frontier.isEmpty():
            break
    through = join_unique(links, known.select(F.col("name").alias("head"), "steps"), "head", "inner")
    return known.unionAll(through.select("name", (F.col("steps") + F.col("offset")).alias("steps")))


def _jumped(links: DataFrame) -> DataFrame:
    """Links (name, head, offset) whose head is no link itself. Links that go round among themselves have no such head
    and no way in; they are left out."""
    bound = links.count().bit_length() + 1
    for _ in range(bound):
        further = links.select(F.col("name").alias("head"), F.col("head").alias("far"), F.col("offset").alias("more"))
        moved = written(join_unique(links, further, "head"), "links")
        links = moved.select("name", F.coalesce("far", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        if moved.where("far IS NOT NULL").isEmpty():
            return links
    return links.join(links.select(F.col("name").alias("head")), "head", "left_anti").select("name", "head", "offset")
