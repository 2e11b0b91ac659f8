"""Input tables of the catalog, derived from the star-schema and text tables.

The SQL fragments here use only what Spark and DuckDB share, so both engines derive the
same rows. No table holds C code or model replies: sources and replies are spelled out
from ``part``, files come from ``documents``, attempts from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.session import spread

NL = "chr(10)"

# --- files: one text file per document -------------------------------------------------
DOCUMENT_PATH = """concat('proj/', source, '/d', doc_id, case doc_id % 8
    when 0 then '.c' when 1 then '.h' when 2 then '.cpp' when 3 then '.HPP'
    when 4 then '.C' when 5 then '.cc' when 6 then '.txt' else '' end)"""

# --- sources: one C text with two functions per part -------------------------------------
SOURCE_PATH = """concat('src/b', p_size, '/p', p_partkey,
    case when p_type = 'PROMO' then '.cpp' else '.c' end)"""
F_BODY = f"""concat('int f', p_partkey, '(int a, int b)', {NL}, '{{', {NL},
    '    if (a > ', p_size, ') {{ return b; }}', {NL},
    repeat(concat('    a += ', p_size, '; /* }} */', {NL}), p_size),
    '    return a;', {NL}, '}}')"""
# One text per size: its copies sit in as many files as parts have that size.
G_BODY = """concat('static void *g(const char *name) { return h', p_size, '(name); }')"""
SOURCE_HEAD = f"""case p_partkey % 5
    when 0 then concat('// helper {{ for ', p_name, {NL})
    when 1 then concat('/* block {{', {NL}, '   ', p_name, ' */', {NL})
    when 2 then concat('#include <stdio.h>', {NL}, '#include "', replace(p_name, ' ', '_'), '.h"',
                       {NL}, '#define OPEN {{', {NL})
    when 3 then concat('static const char *s', p_partkey, ' = "}}{{";', {NL})
    else concat('int f', p_partkey, '(int a, int b);', {NL}) end"""
SOURCE_TEXT = f"""case p_brand
    when 'Brand#24' then concat('int only', p_partkey, '(void);', {NL})
    else concat({SOURCE_HEAD}, {F_BODY}, {NL}, {NL}, {G_BODY}, {NL},
        case p_brand when 'Brand#25' then concat('int open', p_partkey, '(void) {{', {NL}) else '' end)
    end"""

# --- replies to the chunks of the sources ------------------------------------------------
_TAIL = """concat('"data_flow":{"inputs":"i","outputs":"o","side_effects":"s"},"call_graph":{"calls":["g","h',
    p_size, '"],"called_by":["main"]},"state_management":"m","assumptions":"a"}')"""
F_REPLY = f"""case p_partkey % 8
    when 0 then concat('{{"function_role":"', p_brand, '","behavior":{{"normal_case":"n",',
        '"special_cases":["x"],"error_cases":[]}},', {_TAIL})
    when 1 then concat('Answer: {{"function_role":"', p_brand, '","behavior":{{"normal_case":"n"}},', {_TAIL}, ' done')
    when 2 then concat('```json', {NL}, '{{"function_role":"', p_brand, '","behavior":{{"normal_case":"n"}},',
        {_TAIL}, {NL}, '```')
    when 3 then '{{"function_role":"only"}}'
    when 4 then 'no json here'
    when 5 then concat('{{"function_role":7,"behavior":{{"normal_case":"n"}},', {_TAIL})
    when 6 then concat('{{"function_role":"r","behavior":{{"normal_case":""}},', {_TAIL})
    else concat('[{{"function_role":"r","behavior":{{"normal_case":"n"}},', {_TAIL}, ']') end"""
G_REPLY = f"""concat('{{"function_role":"wraps h', p_size, '","behavior":{{"normal_case":"calls on"}},', {_TAIL})"""
# Chunks of this brand never got a reply.
REPLIED = "p_brand <> 'Brand#13'"

# --- attempts: events as a log of tries ---------------------------------------------------
OUTCOME = """case event_type when 'error' then 'transient' when 'purchase' then 'success'
    else 'in flight' end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", "source", "lang", F.expr(DOCUMENT_PATH).alias("path"), F.col("text").alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of C and C++ text as the loader would give them."""
    from srcloom.functions import text as tx

    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    texts = parts.select(F.expr(SOURCE_PATH).alias("path"), F.expr(SOURCE_TEXT).alias("content"))
    return texts.select(
        "path",
        "content",
        tx.detect_language(F.col("path")).alias("language"),
        tx.line_count(F.col("content")).alias("line_count"),
    )


def responses_of(parts: DataFrame) -> DataFrame:
    """Replies keyed by content id; the replies of copied functions come in two versions."""
    f_replies = parts.where(REPLIED).selectExpr(
        f"sha2({F_BODY}, 256) as chunk_id", f"{F_REPLY} as raw", "bigint(p_size * 10) as tokens", "1 as version"
    )
    sizes = parts.select("p_size").distinct()
    g_replies = sizes.selectExpr(f"sha2({G_BODY}, 256) as chunk_id", f"{G_REPLY} as raw", "explode(array(1, 2)) as version")
    old = F.col("version") == 1
    g_rows = g_replies.select(
        "chunk_id",
        F.when(old, F.lit("stale")).otherwise(F.col("raw")).alias("raw"),
        F.when(old, F.lit(99)).otherwise(F.lit(20)).cast("bigint").alias("tokens"),
        "version",
    )
    return f_replies.unionByName(g_rows)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_of(spread(table(spark, sf_dir, "part"), "p_partkey"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.expr("event_id div 4").alias("chunk_id"),
        F.expr(OUTCOME).alias("outcome"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        "user_id",
        "event_id",
    )
