"""Stored tables that change by parts, and runs that take up where the last one left off."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.operators import reports, stored
from srcloom.operators.functions_table import parse_files
from srcloom.plans import incremental
from srcloom.plans.analysis import analyze_parsed
from srcloom.sources.files import load_files, scan_files


def parquet_files(folder):
    return set(glob.glob(f"{folder}/data/**/*.parquet", recursive=True))


def manifest(spark, folder, version):
    rows = spark.read.schema(stored.MANIFEST).parquet(f"{folder}/manifests").where(F.col("version") == version).collect()
    return {r.part: r.path for r in rows}


def test_a_delete_rewrites_one_part(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("concat('f', id % 100) as file_path", "id", "id as part")
    stored.create(rows, folder, "file_path", 16)
    gone = spark.createDataFrame([("f7",)], "file_path string")
    files = parquet_files(folder)
    assert stored.replace(spark, folder, gone) == 1
    before, after = manifest(spark, folder, 0), manifest(spark, folder, 1)
    assert len(before) == len(after) == 16 and sum(before[p] != after[p] for p in before) == 1
    written = {os.path.dirname(f) for f in parquet_files(folder) - files}
    assert len(written) == 1
    assert sorted(map(tuple, stored.read(spark, folder).collect())) == sorted(map(tuple, rows.where("file_path <> 'f7'").collect()))
    assert stored.read(spark, folder, 0).count() == 2000
    only = stored.read(spark, folder, keys=spark.createDataFrame([("f8",)], "file_path string"))
    assert 0 < only.count() < 600 and only.where("file_path = 'f8'").count() == 20


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(50).selectExpr("id", "id * 2 as v")
    stored.create(rows, folder, "id", 4)
    bad = spark.range(10).selectExpr("id", "if(id = 7, cast(raise_error('broken') as bigint), id) as v")
    with pytest.raises(Exception, match="broken"):
        stored.replace(spark, folder, bad.select("id"), bad)
    assert stored.latest_version(spark, folder) == 0
    assert sorted(map(tuple, stored.read(spark, folder).collect())) == [(i, 2 * i) for i in range(50)]


def test_upserts_null_keys_and_empty_parts(spark, tmp_path):
    folder = str(tmp_path / "t")
    stored.create(spark.createDataFrame([], "k string, v int"), folder, "k", 8)
    assert stored.read(spark, folder).count() == 0
    stored.upsert(spark, folder, spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int"))
    stored.upsert(spark, folder, spark.createDataFrame([(None, 5), ("b", 4)], "k string, v int"))
    assert sorted(map(tuple, stored.read(spark, folder).collect()), key=repr) == [("a", 3), ("b", 4), (None, 5)]
    stored.replace(spark, folder, spark.createDataFrame([("a",), (None,)], "k string"))
    assert sorted(map(tuple, stored.read(spark, folder).collect())) == [("b", 4)]
    # A version may be based on an older one.
    stored.replace(spark, folder, spark.createDataFrame([("b",)], "k string"), version=1)
    assert sorted(map(tuple, stored.read(spark, folder).collect()), key=repr) == [("a", 3), (None, 2)]
    with pytest.raises(ValueError):
        stored.read(spark, folder, 99)


REPLY = '{"function_role":"r","behavior":{"normal_case":"n"},"data_flow":{"inputs":"i","outputs":"o","side_effects":"s"},"call_graph":{"calls":[],"called_by":[]},"state_management":"m","assumptions":"a"}'


def full(spark, files, replies):
    parsed = parse_files(files)
    rows = analyze_parsed(parsed, replies)
    return parsed, rows


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_three_snapshots_equal_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = str(tmp_path / "store")
    incremental.start(spark, store, parts=4)
    texts = {f"d{i}/x{i}.c": f"int f{i}(int a) {{ return a + {i}; }}\n" for i in range(12)}
    texts["p.cpp"] = "int f() { return 1; }\n"
    texts["none.h"] = "int f(int);\n"
    answered = set()
    for step in range(3):
        for path in rng.sample(sorted(texts), 5):
            change = rng.choice(["change", "remove", "copy"])
            if change == "remove":
                del texts[path]
            elif change == "change":
                texts[path] += f"int g{step}(void) {{ return {rng.randint(0, 3)}; }}\n"
            else:
                texts[f"copy{step}/{path}"] = texts[path]
        raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, bytes binary")
        files = load_files(raw).cache()
        parsed = parse_files(files)
        ids = sorted(r[0] for r in parsed.select(F.explode("functions.body").alias("b")).select(tx.content_hash(F.col("b"))).distinct().collect())
        answered |= set(rng.sample(ids, len(ids) // 2))
        replies = spark.createDataFrame([(i, REPLY if int(i[0], 16) % 3 else "no", 7) for i in sorted(answered)] or [("-", "", 0)], "chunk_id string, raw string, tokens long")
        loaded = []

        def load(fresh, files=files, loaded=loaded):
            loaded.append({r.path for r in fresh.collect()})
            return files.join(fresh, "path", "left_semi")

        before = dict(map(tuple, stored.read(spark, f"{store}/files").collect()))
        done = incremental.update(spark, store, files.select("path", "hash"), load, replies)
        parsed, results = full(spark, files, replies)
        assert rows_of(incremental.results(spark, store)) == rows_of(results)
        outcomes = reports.file_outcome(parsed, results)
        assert rows_of(incremental.outcomes(spark, store).select(outcomes.columns)) == rows_of(outcomes)
        assert rows_of(incremental.run_stats(spark, store)) == rows_of(reports.run_stats(outcomes))
        assert done["analyzer_tokens"] == reports.token_totals(results).first().analyzer_tokens
        # Only changed files are read, and those that a reply has come for.
        changed = {r.path for r in files.collect() if before.get(r.path) != r.hash}
        assert changed <= loaded[0] and (step == 0 or len(loaded[0]) < len(texts))
        files.unpersist()


def test_a_run_asks_only_for_what_it_needs(spark, tmp_path, monkeypatch):
    """Functions are stored without their text, and only the replies to chunks of files that are read are validated."""
    store, stored_as, asked = str(tmp_path / "store"), {}, []
    incremental.start(spark, store, parts=4)
    write, analyze = incremental.written, incremental.analyze_parsed

    def written(df, label):
        stored_as[label] = df.schema
        return write(df, label)

    def analyzed(parsed, responses, *more):
        asked.append(sorted(r.chunk_id for r in responses.collect()))
        return analyze(parsed, responses, *more)

    monkeypatch.setattr(incremental, "written", written)
    monkeypatch.setattr(incremental, "analyze_parsed", analyzed)
    texts = {f"x{i}.c": f"int f{i}(int a) {{ return {i % 4}; }}" for i in range(6)}
    texts["twice.c"] = texts["x1.c"]
    known = {}
    for step in range(2):
        raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, bytes binary")
        files = load_files(raw)
        ids = {r.path: r.id for r in parse_files(files).select("path", tx.content_hash(F.col("functions")[0]["body"]).alias("id")).collect()}
        known |= dict.fromkeys(ids.values(), REPLY)
        replies = spark.createDataFrame([*[(i, r, 7) for i, r in known.items()], (None, REPLY, 7), ("unasked", "no", 7)], "chunk_id string, raw string, tokens long")
        done = incremental.update(spark, store, files.select("path", "hash"), lambda fresh: files.join(fresh, "path", "left_semi"), replies)
        assert (done["files"], done["successful_chunks"]) == (7, 7)
        assert asked[-1] == sorted(set(ids.values()) if step == 0 else {ids["x2.c"]})
        texts["x2.c"] = "int other(void) { return 9; }"
    kept = stored_as["parsed"]["functions"].dataType.elementType.names
    assert "body" not in kept and {"chunk_id", "tokens", "start_line"} <= set(kept)


def test_folder_reads_changed_files_only(spark, tmp_path):
    root, store = tmp_path / "src", str(tmp_path / "store")
    root.mkdir()
    for i in range(6):
        (root / f"x{i}.c").write_text(f"int f{i}(void) {{ return {i}; }}\n")
    (root / "notes.txt").write_text("no source")
    incremental.start(spark, store, parts=4)
    none = spark.createDataFrame([], "chunk_id string, raw string, tokens long")
    assert incremental.update_folder(spark, store, str(root), none)["files"] == 6
    (root / "x1.c").write_text("int f1(void) { return 1; }\nint other(void) { return 2; }\n")
    (root / "x2.c").unlink()
    (root / "sub").mkdir()
    (root / "sub" / "new.c").write_text("int added(void) { return 3; }\n")
    done = incremental.update_folder(spark, store, str(root), none)
    assert (done["files"], done["chunks"], done["failed_chunks"]) == (6, 7, 7)
    assert spark.read.parquet(f"{store}/runs").where("run = 2").first().parsed_files == 2
    again = incremental.update_folder(spark, store, str(root), none)
    assert again["chunks"] == 7 and spark.read.parquet(f"{store}/runs").where("run = 3").first().parsed_files == 0
    names = {r.file_path for r in incremental.results(spark, store).collect()}
    assert names == {"x0.c", "x1.c", "x3.c", "x4.c", "x5.c", "sub/new.c"}
    assert scan_files(spark, str(root)).count() == 6
