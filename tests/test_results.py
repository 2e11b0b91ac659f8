"""Replies, result rows and reports, restated on small tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from srcloom.operators import documents, graph, reports, results

GOOD = {
    "function_role": "sums two ports",
    "behavior": {"normal_case": "returns the sum", "special_cases": ["wraps at 2^32"], "error_cases": []},
    "data_flow": {"inputs": "p, q", "outputs": "sum", "side_effects": "sets a flag"},
    "call_graph": {"calls": ["helper"], "called_by": ["main"]},
    "state_management": "one static flag",
    "assumptions": "ports are open",
    "notes": "kept from the first release",
}
TEXT = json.dumps(GOOD)


def variant(**changes):
    """The good reply with other values at some paths; ``...`` takes a key out."""
    reply = json.loads(TEXT)
    for path, value in changes.items():
        *outer, last = path.split("__")
        target = reply
        for key in outer:
            target = target[key]
        if value is ...:
            del target[last]
        else:
            target[last] = value
    return json.dumps(reply)


# Replies and the fields that fail in each, spelled out.
REPLIES = [
    (TEXT, []),
    (json.dumps(GOOD, indent=2), []),
    (f"\n\n {TEXT}\t", []),
    (f"Sure, see below. {TEXT} Anything else? {{ }}", []),
    (f"Result:\n```json\n{TEXT}\n```\nDone.", []),
    (f"{{not yet}} but then\n```json\n{TEXT}\n```", []),
    (variant(extra={"depth": [1, 2]}), []),
    (variant(notes=...), []),
    (variant(notes=""), []),
    (variant(behavior__special_cases=..., behavior__error_cases=...), []),
    (variant(call_graph={}), []),
    (variant(function_role=" "), []),
    (variant(function_role='says "{stop}" \\n ü'), []),
    ("", ["json"]),
    ("sorry, nothing", ["json"]),
    ("{oops", ["json"]),
    ("17", ["json"]),
    ("null", ["json"]),
    ("[]", ["json"]),
    (f"[{TEXT}]", ["json"]),
    ('"a text with {braces}"', ["json"]),
    ("{}", ["behavior", "data_flow", "call_graph", "function_role", "state_management", "assumptions"]),
    ('{"function_role": "half"}', ["behavior", "data_flow", "call_graph", "state_management", "assumptions"]),
    (variant(function_role=""), ["function_role"]),
    (variant(function_role=3), ["function_role"]),
    (variant(function_role=None), ["function_role"]),
    (variant(behavior__normal_case=""), ["behavior.normal_case"]),
    (variant(behavior__special_cases=None), ["behavior.special_cases"]),
    (variant(behavior__special_cases=[2]), ["behavior.special_cases"]),
    (variant(behavior__special_cases=["x", None]), ["behavior.special_cases"]),
    (variant(behavior__error_cases="one"), ["behavior.error_cases"]),
    (variant(behavior=None), ["behavior"]),
    (variant(behavior=[]), ["behavior"]),
    (variant(call_graph=...), ["call_graph"]),
    (variant(call_graph__calls=["x", 9]), ["call_graph.calls"]),
    (variant(data_flow={}), ["data_flow.inputs", "data_flow.outputs", "data_flow.side_effects"]),
    (variant(data_flow__inputs={"p": 1}), ["data_flow.inputs"]),
    (variant(state_management=..., assumptions=False), ["state_management", "assumptions"]),
    (variant(notes=None), ["notes"]),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(REPLIES)], "i int, raw string")
    rows = {r.i: r for r in results.validate_responses(df, "raw").collect()}
    for i, (text, failing) in enumerate(REPLIES):
        assert rows[i].errors == failing, text
        assert (rows[i].error is None) == (failing == []) == (rows[i].reply is not None)
    assert rows[0].reply.asDict(recursive=True) == GOOD
    assert rows[7].reply.notes == "" and rows[10].reply.call_graph.calls == []
    assert rows[12].reply.function_role == 'says "{stop}" \\n ü'


def test_repeated_key_keeps_last(spark):
    text = json.dumps(GOOD)[:-1] + ', "notes": "last"}'
    df = spark.createDataFrame([(text,)], "raw string")
    assert results.validate_responses(df, "raw").first().reply.notes == "last"


def chunk_table(spark, n=3):
    rows = [(f"id{i}", f"f{i}", f"src/{'a' if i < 2 else 'b'}.c", i, i + 1, 5, i % 2 + 1, 10) for i in range(n)]
    schema = ("chunk_id string, chunk_name string, file_path string, start_line int, end_line int, "
              "line_count int, position int, tokens bigint")
    return spark.createDataFrame(rows, schema)


def result_rows(spark):
    answers = [("id0", json.dumps(GOOD), 150, 1), ("id0", "older", 9, 0), ("id1", "nonsense", 50, 1)]
    replies = spark.createDataFrame(answers, "chunk_id string, raw string, tokens bigint, version int")
    return results.assemble_results(results.join_responses(chunk_table(spark), replies, "version"))


def test_results_keep_failures(spark):
    rows = {r.chunk_name: r for r in result_rows(spark).collect()}
    ok, bad, missing = rows["f0"], rows["f1"], rows["f2"]
    assert (ok.status, ok.tokens_used, ok.function_role, ok.call_graph.calls) == ("ok", 150, "sums two ports", ["helper"])
    assert (bad.status, bad.tokens_used, bad.raw_response) == ("invalid", 50, "nonsense")
    assert bad.function_role.startswith("[analysis failed]No JSON object")
    assert len(bad.behavior.special_cases) == len(bad.call_graph.called_by) == 1
    assert (missing.status, missing.tokens_used, missing.raw_response) == ("missing", 0, "")


def test_replies_are_chosen_without_sorting_texts(spark):
    table = spark.createDataFrame([("a", "long old", 99, 1), ("a", "new", 2, 2)], "chunk_id string, raw string, tokens bigint, version int")
    latest = results.latest_replies(table, "version")
    assert latest.first().answer.raw == "new" and results.latest_replies(table).first().answer.raw == "long old"
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_null_reply_and_usage(spark):
    replies = spark.createDataFrame([("id0", None, None)], "chunk_id string, raw string, tokens bigint")
    row = results.assemble_results(results.join_responses(chunk_table(spark, 1), replies)).first()
    assert (row.raw_response, row.tokens_used, row.status) == ("", 0, "invalid")


def test_caller_function_answers(spark):
    prompts = spark.createDataFrame([(f"id{i}", f"p{i}") for i in range(5)], "chunk_id string, prompt string")

    def reply(batch):
        return pd.DataFrame({"raw": batch.str.upper(), "tokens": batch.str.len()})

    got = {(r.chunk_id, r.raw, r.tokens) for r in results.call_models(prompts, reply).collect()}
    assert got == {(f"id{i}", f"P{i}", 2) for i in range(5)}


def test_prompt(spark):
    df = spark.createDataFrame([("int x = 100 % 3;", ""), ("y", "ctx"), ("z", None)], "code string, context string")
    rows = results.render_prompts(df).collect()
    assert "int x = 100 % 3;" in rows[0].prompt and "No context" in rows[0].prompt
    assert "ctx" in rows[1].prompt and "No context" not in rows[1].prompt
    assert "No context" in rows[2].prompt and rows[0].system_prompt


def test_round_robin(spark):
    rows = results.assign_models(chunk_table(spark, 5), ["m1", "m2"], ["file_path", "start_line"])
    assert [r.model for r in rows.orderBy("request").collect()] == ["m1", "m2", "m1", "m2", "m1"]
    with pytest.raises(ValueError):
        results.assign_models(chunk_table(spark), [], ["file_path"])


def test_reports(spark):
    rows = result_rows(spark)
    table = {r.function: r for r in reports.functions_table(rows).collect()}
    assert set(table) == {"f0", "f1"} and table["f0"].file == "src/a.c"
    assert (table["f0"].calls, table["f0"].special_cases, table["f0"].error_cases, table["f0"].tokens) == (1, 1, 0, 150)
    metrics = {(r.category, r.metric): r.value for r in reports.metrics_long(rows).collect()}
    assert metrics == {
        ("project", "total_files"): 1, ("project", "total_functions"): 2, ("project", "total_lines"): 200,
        ("quality", "error_cases"): 1, ("quality", "special_cases"): 2, ("tokens", "total_tokens"): 200,
    }
    totals = reports.token_totals(rows).first()
    assert (totals.analyzer_tokens, totals.run_tokens) == (150, 200)


def test_file_part_of_ids(spark):
    row = result_rows(spark).where("chunk_name = 'f0'").withColumn("chunk_id", F.lit("test.c:add"))
    assert reports.functions_table(row).first().file == "test.c"
    nowhere = row.withColumn("chunk_id", F.lit("plain")).withColumn("file_path", F.lit(None).cast("string"))
    assert reports.functions_table(nowhere).first().file == "unknown"


def test_empty_results(spark):
    empty = result_rows(spark).where(F.lit(False))
    assert reports.functions_table(empty).count() == 0
    assert {r.value for r in reports.metrics_long(empty).collect()} == {0}
    assert documents.file_documents(empty).count() == 0


def outcome(spark, **counts):
    names = ["chunks", "successful_chunks", "failed_chunks", "invalid_chunks", "total_tokens"]
    values = [counts.get(n, 0) for n in names]
    schema = "path string, outcome string, " + ", ".join(f"{n} bigint" for n in names)
    return spark.createDataFrame([("a.c", "successful", *values)], schema)


def test_rates_and_gate(spark):
    stats = reports.run_stats(outcome(spark, chunks=100, successful_chunks=95, failed_chunks=5))
    row = stats.first()
    assert (row.error_rate, row.success_rate) == (0.05, 0.95)
    assert reports.quality_gate(stats).first().verdict == "pass"
    none = reports.run_stats(outcome(spark))
    assert (none.first().error_rate, none.first().success_rate) == (0.0, 1.0)
    gate = reports.quality_gate(none).first()
    assert (gate.verdict, gate.reason) == ("fail", "no chunks analyzed")
    high = reports.run_stats(outcome(spark, chunks=100, failed_chunks=6))
    assert reports.quality_gate(high).first().reason == "error rate exceeds limit"


def test_first_errors(spark):
    rows = [("parse", f"a{i:02}.c", 0, f"m{i}") for i in range(13)]
    errors = spark.createDataFrame(rows, "kind string, file_path string, start_line int, message string")
    got = {r.message for r in reports.first_errors(errors).collect()}
    assert got == {f"m{i}" for i in range(10)} | {"... and 3 more"}
    few = reports.first_errors(errors.where("message in ('m1', 'm2')"))
    assert {r.message for r in few.collect()} == {"m1", "m2"}


def test_document_blocks_join_to_one_document(spark):
    def document(per_block):
        blocks = documents.file_documents(result_rows(spark), per_block=per_block).orderBy("block").collect()
        assert [b.block for b in blocks] == list(range(len(blocks)))
        return len(blocks), "".join(b.text for b in blocks)

    (few, text), (many, same) = document(500), document(1)
    assert (few, many) == (3, 4) and text == same
    assert text.startswith("# a.c\n\n**Path**: `src/a.c`\n**Language**: c\n**Functions**: 2\n\n---\n")
    assert "### `f0`\n\n#### Role\nsums two ports\n" in text and "**Error cases**" in text.split("### `f1`")[1]
    assert "**Error cases**" not in text.split("### `f1`")[0]
    assert text.endswith("---\n\n\n*Generated document.*\n")
    incremental = documents.document_rows(result_rows(spark)).orderBy("file_path", "part", "position").collect()
    assert "**Functions**: 2" not in incremental[0].text and len(incremental) == 4


def test_edges(spark):
    edges = graph.call_edges(result_rows(spark))
    assert {tuple(r) for r in edges.collect()} == {("f0", "helper"), ("main", "f0")}
    functions = spark.createDataFrame([("f0", "a.c", 1), ("helper", "z.c", 4), ("helper", "b.c", 9)], "name string, file_path string, start_line int")
    got = {r.callee: r for r in graph.resolve_calls(edges, functions).collect()}
    assert (got["helper"].definitions, got["helper"].callee_file, got["helper"].caller_known) == (2, "b.c", True)
    assert (got["f0"].resolved, got["f0"].caller_known) == (True, False)
