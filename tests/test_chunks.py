import random

from pyspark.sql import functions as F

from srcloom.operators import chunks as ck
from srcloom.operators.functions_table import extract_functions, parse_files

SOURCE = "src/a.c"


def functions(spark, text):
    df = spark.createDataFrame([(SOURCE, text, "c")], "path string, content string, language string")
    return extract_functions(df)


def test_chunk_record(spark):
    (row,) = ck.make_chunks(functions(spark, "int test_func(int a)\n{ return a;\n}")).collect()
    assert (row.type, row.name, row.tokens) == ("function", "test_func", int(len(row.code) * 0.4))
    m = row.metadata
    assert (m.function_name, m.file_name, m.start_line, m.end_line, m.line_count) == ("test_func", "a.c", 1, 3, 3)
    assert m.params == ["a"] and m.return_type == "int" and m.file_path == SOURCE and len(row.id) == 64


def test_budget_reports_oversize(spark):
    text = "int large(void) {" + " " * 100 + "return 0; }\nint s(void) { }"
    rows = ck.make_chunks(functions(spark, text))
    assert [r.name for r in ck.within_budget(rows, 10).collect()] == ["s"]
    assert [r.name for r in ck.oversize(rows, 10).collect()] == ["large"]
    assert ck.within_budget(rows, 10, min_tokens=7).count() == 0


def test_stats(spark):
    tokens = spark.createDataFrame([(100,), (200,), (150,)], "tokens bigint")
    assert tuple(ck.chunk_stats(tokens).first()) == (3, 450, 150, 100, 200)
    assert tuple(ck.chunk_stats(tokens.limit(0)).first()) == (0, 0, 0, 0, 0)


def packed(text, budget):
    blocks, current, total = [], [], 0
    for line in text.split("\n"):
        tokens = int(len(line) * 0.4)
        if current and total + tokens > budget:
            blocks.append("\n".join(current))
            current, total = [], 0
        current.append(line)
        total += tokens
    return [*blocks, "\n".join(current)]


def test_blocks_against_greedy_walk(spark):
    rng = random.Random(5)
    texts = ["", "\n", "x" * 500, "a\n" * 50, "\n\n\n"]
    for size in (3, 40, 400, 3000):
        texts.append("\n".join("y" * rng.choice([0, 0, 1, 5, 30, 60, 300]) for _ in range(size)))
    for budget in (1, 10, 100, 5000):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        rows = ck.block_split(df, "k", "t", budget).orderBy("k", "block").collect()
        for k, text in enumerate(texts):
            got = [r.code for r in rows if r.k == k]
            assert got == packed(text, budget)
            assert "\n".join(got) == text


def test_hybrid(spark):
    text = "int big(void)\n{\n" + "    step(1, 2, 3);\n" * 20 + "}\nint s(void) { }"
    rows = ck.hybrid_split(functions(spark, text), 40).orderBy("start_line", "part").collect()
    big = [r for r in rows if r.parent == "big"]
    assert [r.name for r in big] == [f"big_part{i + 1}" for i in range(len(big))] and len(big) > 2
    assert {r.type for r in big} == {"function_part"}
    assert "\n".join(r.code for r in big) == text.split("\nint s")[0]
    assert [(r.name, r.type, r.parent) for r in rows if not r.parent] == [("s", "function", None)]


def test_overlap(spark):
    bodies = [f"int f{i}(void)\n{{\n    a{i}();\n    b{i}();\n}}" for i in range(3)]
    df = spark.createDataFrame([(SOURCE, "\n".join(bodies), "c")], "path string, content string, language string")
    parsed = parse_files(df)

    def codes(**kw):
        return [r.code for r in ck.overlap_functions(parsed, **kw).orderBy("start_line").collect()]

    assert codes(lines=0) == bodies
    assert codes(ratio=0.0) == bodies
    assert codes(lines=2)[1] == "    b0();\n}\n" + bodies[1] + "\nint f2(void)\n{"
    assert codes(lines=99)[1] == "\n".join(bodies)
    assert codes(ratio=0.2)[0] == bodies[0] + "\nint f1(void)"


def test_context_is_capped(spark):
    text = "#include <stdio.h>\n#define N 3\n#include \"x.h\"\nint f(void) { }"
    df = spark.createDataFrame([(SOURCE, text, "c")], "path string, content string, language string")
    parsed = parse_files(df)
    assert ck.chunk_context(parsed).first().context == "#include stdio.h\n#include x.h\n#define N"
    assert [(r.context, r.context_truncated) for r in ck.chunk_context(parsed, max_tokens=14).collect()] == [("#include stdio.h\n#include x.h", True)]


def test_dedup_keeps_first_place(spark):
    body = "int f(void) { }"
    df = spark.createDataFrame([(p, body, "c") for p in ("b.c", "a.c", "c.c")], "path string, content string, language string")
    (row,) = ck.dedup_chunks(ck.make_chunks(extract_functions(df))).collect()
    assert (row.file_path, row.copies, row.name) == ("a.c", 3, "f")


def test_distinct_counts(spark):
    df = spark.createDataFrame([("aaaaa",), ("aaaaa",), ("bbbbbbbbbb",)], "t string")
    counts = ck.distinct_token_counts(df, "t")
    assert sorted((r.tokens, r.occurrences) for r in counts.collect()) == [(2, 2), (4, 1)]
