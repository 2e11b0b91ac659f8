"""Ordering, retries, snapshots, vectors, streams and a whole run."""

import csv
import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcloom.operators import ordering, retries, skew, snapshot, vectors
from srcloom.plans.analysis import run
from srcloom.streaming import streams


def test_positions_with_a_hot_key(spark):
    """A third of the rows share one path; numbers and sums still run through."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 700)).alias("path"),
        F.col("id").alias("line"),
        (F.col("id") % 11).alias("tokens"),
    )
    got = ordering.with_global_position(rows, ["path", "line"], {"upto": "tokens"}).orderBy("position").collect()
    expected = sorted(rows.collect(), key=lambda r: (r.path, r.line))
    assert [(r.path, r.line) for r in got] == [(r.path, r.line) for r in expected]
    assert [r.position for r in got] == list(range(1, 9001))
    assert [r.upto for r in got] == np.cumsum([r.tokens for r in expected]).tolist()


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_join_with_hot_keys(spark, how):
    """A third of the rows share one key, and more than 1,000 others are frequent."""
    rows = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 1500)) as k", "id")
    lookup = rows.selectExpr("k").distinct().where("k = 'hot' or k < 'k3'").selectExpr("k", "length(k) as v")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    got = skew.join_unique(rows, lookup, "k", how)
    assert len(jobs.getJobIdsForGroup()) == before
    plain = rows.join(lookup, "k", how)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_a_hot_partition_is_split(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as k", "id")
        lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = skew.join_unique(rows, lookup, "k")
        assert joined.count() == 60000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def limits_hold(rows, requests, tokens):
    sums = {}
    for r in rows:
        sums.setdefault(r.slot, []).append(r.tokens)
    assert all(len(t) <= requests and (sum(t) <= tokens or len(t) == 1) for t in sums.values())
    assert [r.slot for r in rows] == sorted(r.slot for r in rows) and set(sums) == set(range(len(sums)))
    return len(sums)


@pytest.mark.parametrize("sizes", [[3000] * 8, [1] * 2500 + [60] * 500, [0, 9999, 2, 9999, 10000, 1, 20000, 5], [None, 7] * 300])
def test_rate_slots_keep_both_limits(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "i int, tokens bigint").fillna(0)
    placed = ordering.rate_slots(rows, ["i"], "tokens").orderBy("i").collect()
    used = limits_hold(placed, 500, 10000)
    whole = sum(max(r.tokens / 10000, 1 / 500) for r in placed)
    assert used <= 2 * whole + 1
    assert [r.over_limit for r in placed] == [r.tokens > 10000 for r in placed]
    one = ordering.rate_slots(rows, ["i"], "tokens", requests_per_minute=1).orderBy("i").collect()
    assert limits_hold(one, 1, 10000) == len(sizes)


def test_retries(spark):
    log = [("a", "transient", 0), ("a", "transient", 10), ("b", "transient", 0), ("b", "success", 5),
           ("c", "transient", 0), ("c", "transient", 400), ("d", "in flight", 0),
           *[("e", "transient", t) for t in range(5)]]
    attempts = spark.createDataFrame(log, "chunk_id string, outcome string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    summary = {r.chunk_id: r for r in retries.attempt_summary(attempts).collect()}
    assert (summary["a"].failures, summary["a"].gave_up, summary["a"].retries) == (2, False, 2)
    assert summary["c"].gave_up and summary["e"].gave_up and summary["e"].retries == 4
    assert summary["b"].succeeded and not summary["b"].gave_up
    queue = {r.chunk_id: r.next_wait_seconds for r in retries.retry_queue(attempts).collect()}
    assert queue == {"a": 2.0}
    assert retries.retry_queue(attempts, max_wait=11).first().next_wait_seconds == 1.0


def test_diff_leads_to_the_new_snapshot(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, hash string")
    diff = {r.path: r.change for r in snapshot.snapshot_diff(old, new).collect()}
    assert diff == {"a": "removed", "b": "same", "c": "changed", "d": "added"}
    assert sorted(map(tuple, snapshot.apply_diff(old, new).collect())) == sorted(map(tuple, new.collect()))


def test_cache_halves(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, hash string")
    cache = spark.createDataFrame([("1",), ("1",), ("7",)], "hash string")
    hits, misses = snapshot.cache_hits(files, cache), snapshot.cache_misses(files, cache)
    assert ({r.path for r in hits.collect()}, {r.path for r in misses.collect()}) == ({"a", "c"}, {"b"})
    assert {r.path for r in snapshot.cache_split(files, cache).where("cached").collect()} == {"a", "c"}
    assert {r.path for r in snapshot.delete_by_file(files.withColumnRenamed("path", "file_path"), spark.createDataFrame([("a",)], "file_path string")).withColumnRenamed("file_path", "path").collect()} == {"b", "c"}


def test_upsert(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    fresh = spark.createDataFrame([(2, "new"), (3, "z"), (3, "z")], "id int, v string")
    assert sorted(map(tuple, snapshot.upsert(table, fresh, "id").collect())) == [(1, "x"), (2, "new"), (3, "z")]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 8)).round(3)
    rows = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(6)


def nearest(data, query, k, allowed=None):
    distance = ((data - query) ** 2).sum(axis=1)
    order = [i for i in np.lexsort((np.arange(len(data)), distance)) if allowed is None or allowed(i)]
    return order[:k]


def test_vector_search(points):
    data, table = points
    got = [r.vec_id for r in vectors.search(table, data[7].tolist(), 4).collect()]
    assert got == nearest(data, data[7], 4)
    some = vectors.search(table, data[7].tolist(), 4, where=F.col("label") == 2)
    assert [r.vec_id for r in some.collect()] == nearest(data, data[7], 4, lambda i: i % 4 == 2)


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_many_queries_in_cells(points, monkeypatch, size):
    monkeypatch.setattr(vectors, "CELL_BYTES", size)
    data, table = points
    queries = table.where("vec_id >= 380").selectExpr("vec_id as query_id", "embedding as query")
    got = vectors.search_many(table, queries, 3).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [i for q in range(380, 400) for i in nearest(data, data[q], 3)]


def peak_mb(work):
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_full_cell_is_ranked_in_blocks():
    """Not all distances of a cell are held at once: those of all its queries to all its rows would be 200 MB."""
    rng = np.random.default_rng(5)
    own, wanted = rng.integers(0, 9, size=(6000, 4)).astype(float), rng.integers(0, 9, size=(4096, 4)).astype(float)
    (which, found, distance), peak = peak_mb(lambda: vectors.nearest(own, wanted, 3))
    assert peak < 64
    assert which.tolist() == np.repeat(np.arange(4096), 3).tolist()
    for q in range(0, 4096, 97):
        assert found[3 * q : 3 * q + 3].tolist() == nearest(own, wanted[q], 3)
        assert distance[3 * q : 3 * q + 3].tolist() == sorted(((own - wanted[q]) ** 2).sum(1))[:3]


def test_pairs_of_many_buckets_are_cut_as_they_come():
    """Only the best pairs of a query are kept from bucket to bucket; all of them would be 40 MB, and their order more."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    own, wanted = rng.integers(0, 5, size=(2560, 2)).astype(float), rng.integers(0, 5, size=(1000, 2)).astype(float)
    bucket = np.arange(2560) % 256
    probed = [np.sort(rng.choice(256, 255 if i % 2 else 128, replace=False)) for i in range(1000)]
    left = pa.table({"v": pa.array(own.tolist()), "bucket": pa.array(bucket, pa.int32())})
    right = pa.table({"q": pa.array(wanted.tolist()), "probed": pa.array([p.tolist() for p in probed], pa.list_(pa.int32()))})
    (which, found, distance), peak = peak_mb(lambda: vectors._buckets_of_a_cell(left, right, 8))
    assert peak < 64
    assert which.tolist() == np.repeat(np.arange(1000), 8).tolist()
    for q in range(0, 1000, 41):
        offered = set(probed[q].tolist())
        assert found[8 * q : 8 * q + 8].tolist() == nearest(own, wanted[q], 8, lambda i: i % 256 in offered)


def test_odd_vectors(spark):
    rows = [("a", [0.0, 0.0]), ("b", None), ("c", [1.0, 0.0, 5.0]), ("d", [3.0, 4.0]), ("e", [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in vectors.search(table, [0.0, 0.0], 2).collect()] == [("a", 0.0), ("e", 0.0)]
    queries = spark.createDataFrame([("x", [0.0, 0.0]), ("y", None), ("z", [1.0])], "query_id string, query array<double>")
    got = vectors.search_many(table, queries, 3).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.distance) for r in got] == [("x", "a", 0.0), ("x", "e", 0.0), ("x", "d", 25.0)]
    assert vectors.search_many(table, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_search_in_buckets(points, monkeypatch, size):
    monkeypatch.setattr(vectors, "CELL_BYTES", size)
    data, table = points
    queries = table.where("vec_id >= 300").selectExpr("vec_id as query_id", "embedding as query")
    indexed = vectors.with_buckets(table, tables=3, bits=6)
    exact = vectors.search_many(table, queries, 4)
    found = vectors.search_buckets(indexed, queries, 4, share=0.3, tables=3, bits=6)
    rows = found.collect()
    assert len(rows) == len({(r.query_id, r.vec_id) for r in rows}) == 400
    for r in rows:
        assert r.distance == ((data[r.query_id] - data[r.vec_id]) ** 2).sum()
    # Exactly the nearest of what the buckets offer.
    directions, every = vectors.planes(8, 3, 6), (np.arange(64)[:, None] >> np.arange(6)) & 1
    codes = np.stack([(data @ p.T > 0) @ (1 << np.arange(6)) for p in directions])
    wanted = set()
    for q in range(300, 400):
        offered = set()
        for p, code in zip(directions, codes):
            margins = p @ data[q]
            cost = ((every != (margins > 0)) * margins**2).sum(1)
            offered |= set(np.flatnonzero(np.isin(code, np.argsort(cost)[:19])).tolist())
        wanted |= {(q, i, k) for k, i in enumerate(nearest(data, data[q], 4, offered.__contains__), 1)}
    assert {(r.query_id, r.vec_id, r.rank) for r in rows} == wanted
    row = vectors.recall(exact, found).first()
    assert row.wanted == 400 and row.recall > 0.9
    looked = vectors.looked_into(indexed, queries, 0.3, 3, 6).first()
    assert (looked.queries, looked.vectors) == (100, 400) and 0.2 < looked.share / 3 < 0.4
    # All buckets offer all vectors.
    whole = vectors.search_buckets(indexed, queries, 4, share=1.0, tables=3, bits=6)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_a_common_vector_is_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_BYTES", 16 * 50)
    table = spark.range(600).selectExpr("id as vec_id", "if(id % 3 = 0, array(1d, 1d), array(double(id), 2d)) as embedding")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 2.0])], "query_id long, query array<double>")
    for found in (vectors.search_many(table, queries, 3), vectors.search_buckets(vectors.with_buckets(table), queries, 3, 1.0)):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
        assert got == [(1, 1, 0), (1, 2, 3), (1, 3, 6), (2, 1, 2), (2, 2, 4), (2, 3, 1)]


ALONE = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()[{name!r}](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["vector_topk", "vector_buckets", "extract_functions"])
def test_first_query_of_a_session_elsewhere(tmp_path, name):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ALONE.format(repo=repo, name=name)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_many_queries_do_not_pass_through_the_driver(spark, points, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    data, table = points
    queries = spark.range(5000).selectExpr("id as query_id", "transform(sequence(1, 8), x -> double(x + id % 7)) as query")
    with monkeypatch.context() as patched:
        for name in ("collect", "toPandas", "toLocalIterator", "first", "count"):
            patched.setattr(DataFrame, name, None)
        found = vectors.search_many(table, queries, 2)
    assert found.count() == 10000


def test_retrieval_accuracy(spark):
    rows = [(1, True), (1, False), (2, False)]
    row = vectors.retrieval_accuracy(spark.createDataFrame(rows, "query_id int, rel boolean"), F.col("rel")).first()
    assert (row.queries, row.hits, row.accuracy) == (2, 1, 0.5)


def test_stream_rerun_adds_only_new_input(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.range(10).write.parquet(source)
    streams.run_available(streams.file_stream(spark, source).selectExpr("id * 2 as v"), sink, log)
    streams.run_available(streams.file_stream(spark, source).selectExpr("id * 2 as v"), sink, log)
    assert spark.read.parquet(sink).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    streams.run_available(streams.file_stream(spark, source).selectExpr("id * 2 as v"), sink, log)
    assert sorted(r.v for r in spark.read.parquet(sink).collect()) == [2 * i for i in range(15)]


def test_stream_forgets_after_expiry(spark, tmp_path):
    source = str(tmp_path / "in")

    def batch(rows):
        spark.createDataFrame(rows, "hash string, day int").selectExpr(
            "hash", "timestamp '2024-01-01' + make_dt_interval(day) as ts"
        ).coalesce(1).write.mode("append").parquet(source)

    sink, log = str(tmp_path / "out"), str(tmp_path / "log")
    for rows in ([("a", 0), ("b", 0), ("a", 5)], [("a", 10), ("z", 90)], [("a", 91), ("z", 92)]):
        batch(rows)
        streams.dedup_into(streams.file_stream(spark, source), "hash", "ts", sink, log)
    got = sorted((r.hash, r.ts.strftime("%m-%d")) for r in spark.read.parquet(sink).collect())
    assert [h for h, _ in got] == ["a", "a", "b", "z"]


def test_stream_appends_csv_with_headers(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for low in (0, 3):
        spark.range(low, low + 3).selectExpr("id", "concat('say \"', id, '\",\n') as text").coalesce(1).write.mode("append").parquet(source)
        streams.append_csv(streams.file_stream(spark, source), sink, log)
    parts = glob.glob(f"{sink}/part-*.csv")
    assert len(parts) == 2 and all(next(csv.reader(open(p))) == ["id", "text"] for p in parts)
    rows = [r for p in parts for r in list(csv.reader(open(p)))[1:]]
    assert sorted(rows) == [[str(i), f'say "{i}",\n'] for i in range(6)]


def test_running_counters_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for low in (0, 10, 20):
        spark.range(low, low + 10).selectExpr("id % 3 as g", "id as v").coalesce(1).write.mode("append").parquet(source)
    stream = streams.file_stream(spark, source, max_files=1)
    got = {r.g: (r.n, r.total) for r in streams.running_counters(stream, "g", {"n": "count(*)", "total": "sum(v)"}).collect()}
    assert got == {g: (10, sum(range(g, 30, 3))) for g in range(3)}


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "project"
    (root / "sub").mkdir(parents=True)
    (root / "calc.c").write_text("#include <a.h>\nint add(int a, int b) {\n    return a + b;\n}\n\nint neg(int a) { return -a; }\n")
    (root / "sub" / "calc.c").write_text("struct s { int a; };\nint mul(int a, int b) { return a * b; }\n")
    (root / "x.cpp").write_text("int f() { return 1; }\n")
    (root / "empty.h").write_text("int add(int, int);\n")
    (root / "large.c").write_text("int large(void) {\n" + "    step();\n" * 60 + "}\n")
    (root / "huge.c").write_text("int huge;\n" * 300)
    return root


BODIES = {"add": "int add(int a, int b) {\n    return a + b;\n}", "mul": "int mul(int a, int b) { return a * b; }"}


def answers(spark, versions=(1,)):
    from test_results import GOOD

    rows = [
        (body, json.dumps({**GOOD, "function_role": f'role {v}, of "{name}"\nend'}), 100 + v, -v)
        for name, body in BODIES.items()
        for v in versions
    ]
    return spark.createDataFrame(rows, "body string, raw string, tokens bigint, version int").selectExpr(
        "sha2(body, 256) as chunk_id", "raw", "tokens", "version"
    )


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_whole_run(spark, tmp_path, project, scheme):
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        done = run(spark, f"{scheme}{project}", answers(spark, (2, 1)), out, "demo", max_tokens=100, version="version", document_per_file=True)
        stats = done.stats.first()
        unread = [tuple(r) for r in done.unread.collect()]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert unread == [("huge.c", "too large for a row")]
    assert (stats.total_files, stats.successful_files, stats.failed_files) == (5, 2, 3)
    assert (stats.total_chunks, stats.successful_chunks, stats.failed_chunks, stats.total_tokens) == (3, 2, 1, 202)
    reasons = {r.path: r.reason for r in done.outcomes.collect()}
    assert reasons == {
        "calc.c": "", "sub/calc.c": "", "x.cpp": "C++ parsing is not supported", "empty.h": "no functions", "large.c": "no chunks",
    }
    assert [(r.file_path, r.chunk_name) for r in done.oversize.collect()] == [("large.c", "large")]
    assert [(r.path, r.start_line, r.reason) for r in done.rejects.collect()] == [("sub/calc.c", 1, "type")]
    assert done.verdict.count() == 1 and {r.file_path for r in done.errors.collect()} == {"x.cpp", "calc.c"}
    prompts = {r.file_path: r for r in done.prompts.where("start_line < 3").collect()}
    assert "#include a.h" in prompts["calc.c"].prompt and "return a * b" in prompts["sub/calc.c"].prompt
    for name in ("outcomes", "stats", "verdict", "errors", "oversize", "rejects", "unread"):
        assert spark.read.option("header", True).csv(f"{out}/run/{name}").count() > 0
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/metrics/functions")
    # The newer reply counts, although the older one has more tokens.
    assert {(r.file, r.function, r.role, r.tokens) for r in found.collect()} == {
        ("calc.c", "add", 'role 1, of "add"\nend', "101"), ("sub/calc.c", "mul", 'role 1, of "mul"\nend', "101"),
    }
    header = next(csv.reader(open(glob.glob(f"{out}/metrics/metrics/part-*.csv")[0])))
    assert header == ["category", "metric", "value"]
    files = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/files/part-*")))
    assert "`calc.c`" in files and "`sub/calc.c`" in files
    single = {p.split("file_path=")[1]: "".join(open(f).read() for f in glob.glob(f"{p}/part-*")) for p in glob.glob(f"{out}/documents/*=*")}
    assert set(single) == {"calc.c", "sub%2Fcalc.c"} and single["calc.c"].startswith("# calc.c")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/project/part-*")))
    assert text.startswith("# demo technical document") and "| [calc.c](files/sub/calc.c.md) | 1 | 2 |" in text
    assert spark.read.json(f"{out}/results").count() == 3


def test_run_refuses_replies_without_a_version(spark, tmp_path, project):
    with pytest.raises(ValueError, match="version"):
        run(spark, str(project), answers(spark, (1, 2)), str(tmp_path / "out"), "demo")


def test_run_with_a_function_that_replies(spark, tmp_path, project):
    import pandas as pd
    from test_results import TEXT

    text = TEXT

    def reply(prompts):
        return pd.DataFrame({"raw": [text] * len(prompts), "tokens": prompts.str.len()})

    done = run(spark, str(project), reply, str(tmp_path / "out"), "demo")
    rows = done.results.collect()
    assert {r.chunk_name for r in rows} == {"add", "neg", "mul", "large"} and all(r.status == "ok" for r in rows)


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from srcloom.session import shared_folder

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://host:7077", "hdfs:///tmp/x")) == "hdfs:///tmp/x"
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077", None))
    assert shared_folder(session("local[2]", None)) == shared_folder(session("local[2]", None))
