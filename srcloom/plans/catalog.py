"""Query catalog: one entry per operator, each over whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.functions import replies
from srcloom.functions import text as tx
from srcloom.operators import chunks as ck
from srcloom.operators import documents, graph, ordering, reports, results, retries, snapshot, stored, vectors
from srcloom.operators.functions_table import (
    explode_functions,
    extract_functions,
    files_without_functions,
    parse_files,
    rejected_blocks,
    without_bodies,
)
from srcloom.plans import incremental, tables
from srcloom.plans.analysis import analyze_parsed, chunk_rows, prompts_of
from srcloom.session import new_folder, spread, tune, written
from srcloom.sources import sinks
from srcloom.sources.files import decoded, filter_sources, load_status, scan_files
from srcloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# Budgets that divide the derived functions into small, kept and oversize ones.
MAX_TOKENS = 300
BLOCK_TOKENS = 400
AS_OF = "2024-03-01 00:00:00"
MODELS = ("model-a", "model-b", "model-c")


def query(function: Query) -> Query:
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    CATALOG[function.__name__] = tuned
    return tuned


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_functions(tables.sources(spark, sf_dir))


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parsed files and results; files are parsed once, whatever reads them after."""
    parsed = written(without_bodies(parse_files(tables.sources(spark, sf_dir))).drop("content"), "parsed")
    return parsed, analyze_parsed(parsed, tables.responses(spark, sf_dir), MAX_TOKENS, version="version")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)[1]


def _written_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without their text, for queries whose join looks at them twice."""
    parsed = without_bodies(parse_files(tables.sources(spark, sf_dir)))
    return written(explode_functions(parsed), "functions")


def _reused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for queries that read them more than once."""
    return written(_results(spark, sf_dir), "results")


# --- scans, sources, sinks ------------------------------------------------------------------


def _raw_files(spark, sf_dir):
    """File bytes of three kinds: UTF-8, UTF-8 with CRLF, and bytes that are not UTF-8."""
    files = tables.files(spark, sf_dir)
    crlf = F.regexp_replace("content", "\n", "\r\n").cast("binary")
    broken = F.concat(F.col("content").cast("binary"), F.unhex(F.lit("E9FF")))
    raw = F.when(F.col("lang") == "de", crlf).when(F.col("lang") == "es", broken)
    return files.select("path", raw.otherwise(F.col("content").cast("binary")).alias("bytes"))


@query
def decode_text(spark, sf_dir):
    text = _raw_files(spark, sf_dir).select("path", decoded(F.col("bytes")).alias("t"))
    return text.select(
        "path",
        F.col("t.encoding").alias("encoding"),
        F.char_length("t.content").cast("bigint").alias("n_chars"),
        F.when(F.col("t.encoding") == "utf-8", tx.content_hash(F.col("t.content"))).alias("hash"),
    )


@query
def load_quarantine(spark, sf_dir):
    status = load_status(_raw_files(spark, sf_dir), strict=True)
    return status.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query
def functions_table(spark, sf_dir):
    return reports.functions_table(_results(spark, sf_dir))


@query
def metrics_long(spark, sf_dir):
    return reports.metrics_long(_results(spark, sf_dir))


@query
def results_json(spark, sf_dir):
    rows = sinks.results_json(_results(spark, sf_dir))
    field = lambda p: F.get_json_object("json", p)
    return rows.select(
        "file_path",
        F.col("start_line").cast("bigint").alias("start_line"),
        field("$.status").alias("status"),
        field("$.function_role").alias("role"),
        field("$.call_graph.calls[1]").alias("second_call"),
    )


# --- projections ----------------------------------------------------------------------------


@query
def content_hash(spark, sf_dir):
    text = tx.normalize_newlines(F.regexp_replace("content", "\n", "\r\n"))
    return tables.files(spark, sf_dir).select("path", tx.content_hash(text).alias("hash"))


@query
def detect_language(spark, sf_dir):
    return tables.files(spark, sf_dir).select(
        "path",
        tx.file_name(F.col("path")).alias("name"),
        tx.relative_path(F.col("path"), "proj").alias("relative_path"),
        tx.suffix(F.col("path")).alias("suffix"),
        tx.detect_language(F.col("path")).alias("language"),
    )


@query
def line_count(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    return files.select("path", tx.line_count(F.col("content")).cast("bigint").alias("lines"))


@query
def token_estimate(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    return files.select("path", tx.token_estimate(F.col("content")).alias("tokens"))


@query
def strip_comments(spark, sf_dir):
    html = spread(tables.table(spark, sf_dir, "pages"), "page_id")
    pages = html.select("page_id", tx.strip_comments(F.col("html")).alias("text"))
    return pages.select("page_id", F.char_length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query
def strip_source_comments(spark, sf_dir):
    sources = tables.sources(spark, sf_dir)
    return sources.select("path", F.md5(tx.strip_comments(F.col("content"))).alias("digest"))


@query
def normalize_whitespace(spark, sf_dir):
    text = tx.normalize_whitespace(tx.remove_comments(F.col("content")))
    return tables.files(spark, sf_dir).select("path", F.md5(text).alias("digest"))


@query
def make_chunks(spark, sf_dir):
    m = "metadata."
    return ck.make_chunks(_functions(spark, sf_dir)).select(
        "id", "type", "name", "tokens",
        F.col(m + "file_path").alias("file_path"),
        F.col(m + "file_name").alias("file_name"),
        F.col(m + "start_line").cast("bigint").alias("start_line"),
        F.col(m + "end_line").cast("bigint").alias("end_line"),
        F.col(m + "line_count").cast("bigint").alias("line_count"),
        F.array_join(m + "params", ",").alias("params"),
        F.col(m + "return_type").alias("return_type"),
    )


@query
def render_prompts(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    chunks = turns.select(
        "conv_id", "turn", F.col("text").alias("code"), F.when(F.col("turn") > 0, F.col("role")).otherwise("").alias("context")
    )
    prompts = results.render_prompts(chunks)
    return prompts.select("conv_id", "turn", F.md5("prompt").alias("digest"))


@query
def embedding_text(spark, sf_dir):
    text = tx.embedding_text(F.col("name"), F.col("body"))
    return _functions(spark, sf_dir).select(
        "file_path", F.col("start_line").cast("bigint").alias("start_line"), F.md5(text).alias("digest")
    )


# --- extraction -----------------------------------------------------------------------------


@query
def extract_functions_(spark, sf_dir):
    return _functions(spark, sf_dir).select(
        "file_path",
        "name",
        F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
        F.col("line_count").cast("bigint").alias("line_count"),
        F.md5("body").alias("digest"),
    )


@query
def function_signature(spark, sf_dir):
    return _functions(spark, sf_dir).select(
        "file_path",
        F.col("start_line").cast("bigint").alias("start_line"),
        "signature",
        F.array_join("params", ",").alias("params"),
        "return_type",
    )


@query
def parse_status(spark, sf_dir):
    parsed = parse_files(tables.sources(spark, sf_dir))
    return parsed.select(
        "path",
        F.col("parse_status").alias("status"),
        F.coalesce("parse_error", F.lit("")).alias("error"),
        F.size("functions").cast("bigint").alias("functions"),
    )


@query
def parse_rejects(spark, sf_dir):
    rejected = rejected_blocks(parse_files(tables.sources(spark, sf_dir)))
    return rejected.withColumn("start_line", F.col("start_line").cast("bigint"))


@query
def extract_includes(spark, sf_dir):
    found = ck.extract_includes(tables.sources(spark, sf_dir))
    return found.select("path", F.col("position").cast("bigint").alias("position"), "include")


@query
def extract_macros(spark, sf_dir):
    found = ck.extract_macros(tables.sources(spark, sf_dir))
    return found.select("path", F.col("position").cast("bigint").alias("position"), "macro")


@query
def call_edges(spark, sf_dir):
    return graph.call_edges(_results(spark, sf_dir))


# --- filters, budget, chunking -----------------------------------------------------------------


@query
def filter_extensions(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    kept = filter_sources(files).select("path", F.lit("with headers").alias("mode"))
    return kept.unionByName(filter_sources(files, False).select("path", F.lit("without headers").alias("mode")))


@query
def budget_filter(spark, sf_dir):
    rows = chunk_rows(_functions(spark, sf_dir), max_tokens=2**31 - 1)
    return ck.budget_status(rows, MAX_TOKENS).groupBy("budget").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens")
    )


@query
def block_split(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    blocks = ck.block_split(files, "path", "content", BLOCK_TOKENS)
    return blocks.select(
        "path", F.col("block").cast("bigint").alias("block"), "tokens", F.md5("code").alias("digest")
    )


@query
def part_overlap(spark, sf_dir):
    """Blocks of files with the edges of their neighbours, over rows of a table."""
    blocks = ck.block_split(tables.files(spark, sf_dir), "path", "content", BLOCK_TOKENS)
    return ck.overlap_parts(blocks, "path", ["block"]).select(
        "path", F.col("block").cast("bigint").alias("block"), "tokens", F.md5("code").alias("digest")
    )


@query
def hybrid_split(spark, sf_dir):
    parts = ck.hybrid_split(_functions(spark, sf_dir), MAX_TOKENS)
    return parts.select(
        "file_path", "type", "name", F.coalesce("parent", F.lit("")).alias("parent"), "tokens",
        F.md5("code").alias("digest"),
    )


@query
def overlap_window(spark, sf_dir):
    rows = ck.overlap_functions(parse_files(tables.sources(spark, sf_dir)), lines=2)
    return rows.select("file_path", "name", "tokens", F.md5("code").alias("digest"))


@query
def chunk_context(spark, sf_dir):
    rows = ck.chunk_context(parse_files(tables.sources(spark, sf_dir)))
    return rows.select("id", "file_path", F.md5("context").alias("digest"), F.col("context_truncated").alias("truncated"))


@query
def run_prompts(spark, sf_dir):
    prompts = prompts_of(parse_files(tables.sources(spark, sf_dir)), MAX_TOKENS)
    return prompts.select("chunk_id", "file_path", F.md5("prompt").alias("digest"), F.col("context_truncated").alias("truncated"))


@query
def files_without_functions_(spark, sf_dir):
    empty = files_without_functions(parse_files(tables.sources(spark, sf_dir)))
    return empty.select("path", F.col("parse_status").alias("status"))


@query
def files_without_result(spark, sf_dir):
    sources = tables.sources(spark, sf_dir)
    done = results.with_result(_results(spark, sf_dir)).select(F.col("file_path").alias("path")).distinct()
    return sources.select("path").join(done, "path", "left_anti")


# --- replies --------------------------------------------------------------------------------------


@query
def join_responses(spark, sf_dir):
    rows = chunk_rows(_written_functions(spark, sf_dir), MAX_TOKENS)
    joined = results.join_responses(rows, tables.responses(spark, sf_dir), "version")
    return joined.select(
        "file_path", "chunk_name", F.md5("raw_response").alias("digest"), "tokens_used", "replied"
    )


@query
def prompt_replies(spark, sf_dir):
    """User turns with the assistant turn that follows, joined as prompts and replies."""
    turns = tables.table(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", "conv_id", turn.cast("string"))
    prompts = turns.where(F.col("role") == "user").select(
        key(F.col("turn")).alias("chunk_id"), F.col("text").alias("code")
    )
    answers = turns.where(F.col("role") == "assistant").select(
        key(F.col("turn") - 1).alias("chunk_id"),
        F.col("text").alias("raw"),
        F.char_length("text").cast("bigint").alias("tokens"),
    )
    joined = results.join_responses(prompts, answers)
    return joined.select("chunk_id", F.md5("raw_response").alias("digest"), "tokens_used", "replied")


@query
def assign_models(spark, sf_dir):
    chunks = _functions(spark, sf_dir).select("file_path", "start_line", "name")
    rows = results.assign_models(chunks, MODELS, ["file_path", "start_line"])
    return rows.select("file_path", "name", F.col("request").alias("position"), "model")


@query
def extract_json(spark, sf_dir):
    checked = tables.responses(spark, sf_dir).withColumn("c", replies.checked_reply("raw"))
    return checked.select(
        "chunk_id",
        "version",
        F.col("c.json").isNotNull().alias("found"),
        F.try_variant_get("c.json", "$.function_role", "string").alias("role"),
    )


@query
def validate_responses(spark, sf_dir):
    checked = results.validate_responses(tables.responses(spark, sf_dir), "raw")
    return checked.select(
        "chunk_id",
        "version",
        F.col("error").isNull().alias("valid"),
        F.array_join("errors", ",").alias("errors"),
        F.col("reply.function_role").alias("role"),
        F.array_join("reply.call_graph.calls", ",").alias("calls"),
        F.col("reply.notes").alias("notes"),
    )


@query
def assemble_results(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "file_path", "chunk_name", "status", "function_role",
        F.col("behavior.normal_case").alias("normal_case"),
        F.array_join("behavior.special_cases", ",").alias("special_cases"),
        F.array_join("call_graph.calls", ",").alias("calls"),
        "notes", "tokens_used",
    )


@query
def retry_queue(spark, sf_dir):
    return retries.retry_queue(tables.attempts(spark, sf_dir), max_attempts=3, max_wait=3600)


@query
def attempt_summary(spark, sf_dir):
    return retries.attempt_summary(tables.attempts(spark, sf_dir), max_attempts=3, max_wait=3600)


# --- joins over snapshots and caches ------------------------------------------------------------


def _new_snapshot(spark, sf_dir):
    return tables.files(spark, sf_dir).select("path", tx.content_hash(F.col("content")).alias("hash"))


def _old_snapshot(spark, sf_dir):
    """Earlier snapshot: labelled documents, toxic ones with other text, and benchmark items."""
    labels = tables.table(spark, sf_dir, "labels")
    docs = tables.files(spark, sf_dir).join(labels, "doc_id")
    text = F.when(F.col("toxic") == 1, F.concat("content", F.lit("\n// old"))).otherwise(F.col("content"))
    day = F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(int(doc_id % 60))")
    known = docs.select("path", tx.content_hash(text).alias("hash"), day.alias("ts"))
    items = tables.table(spark, sf_dir, "benchmark").select(
        F.expr("concat('bench/i', item_id, '.c')").alias("path"),
        tx.content_hash(F.col("text")).alias("hash"),
        F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(int(item_id % 60))").alias("ts"),
    )
    return known.unionByName(items)


@query
def snapshot_diff(spark, sf_dir):
    return snapshot.snapshot_diff(_old_snapshot(spark, sf_dir), _new_snapshot(spark, sf_dir))


@query
def cache_split(spark, sf_dir):
    return snapshot.cache_split(_new_snapshot(spark, sf_dir), _old_snapshot(spark, sf_dir)).select("path", "cached")


@query
def cache_latest(spark, sf_dir):
    latest = snapshot.cache_latest(_old_snapshot(spark, sf_dir))
    return latest.select("hash", "path", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def cache_ttl(spark, sf_dir):
    kept = snapshot.within_ttl(_old_snapshot(spark, sf_dir), AS_OF)
    return kept.select("path", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def delete_by_file(spark, sf_dir):
    rows = chunk_rows(_written_functions(spark, sf_dir))
    parts = tables.table(spark, sf_dir, "part")
    gone = parts.where(F.col("p_type") == "SMALL").select(F.expr(tables.SOURCE_PATH).alias("file_path"))
    return snapshot.delete_by_file(rows, gone).select("chunk_id", "file_path", "chunk_name")


@query
def call_reach(spark, sf_dir):
    """Functions that calls lead to from ``main``, by the replies."""
    edges = graph.call_edges(_results(spark, sf_dir))
    return graph.reached(edges, spark.range(1).select(F.lit("main").alias("name")))


@query
def dependency_steps(spark, sf_dir):
    """Steps from the first parts over chains and leaps between parts."""
    parts = tables.table(spark, sf_dir, "part")
    chains = parts.where("p_size % 7 <> 0").selectExpr("p_partkey as caller", "p_partkey + 1 as callee")
    leaps = parts.where("p_size % 3 = 0").selectExpr("p_partkey as caller", "p_partkey * 2 as callee")
    starts = parts.where("p_partkey between 1 and 10").select(F.col("p_partkey").alias("name"))
    return graph.reached(chains.unionAll(leaps), starts)


@query
def resolve_calls(spark, sf_dir):
    parsed, rows = _analysis(spark, sf_dir)
    resolved = graph.resolve_calls(graph.call_edges(rows), explode_functions(parsed))
    return resolved.withColumn("callee_line", F.col("callee_line").cast("bigint"))


# --- aggregates and reports --------------------------------------------------------------------------


@query
def chunk_stats(spark, sf_dir):
    return ck.chunk_stats(chunk_rows(_functions(spark, sf_dir)))


def _stats(spark, sf_dir):
    parsed, rows = _analysis(spark, sf_dir)
    return reports.run_stats(reports.file_outcome(parsed, rows))


@query
def run_stats(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return stats.withColumn("error_rate", F.round("error_rate", 6)).withColumn(
        "success_rate", F.round("success_rate", 6)
    )


@query
def file_outcome(spark, sf_dir):
    return reports.file_outcome(*_analysis(spark, sf_dir))


@query
def quality_gate(spark, sf_dir):
    return reports.quality_gate(_stats(spark, sf_dir))


@query
def project_summary(spark, sf_dir):
    return reports.project_summary(_results(spark, sf_dir))


@query
def file_summary(spark, sf_dir):
    rows = reports.file_summary(_results(spark, sf_dir), tables.sources(spark, sf_dir))
    return rows.withColumn("total_lines", F.col("total_lines").cast("bigint"))


@query
def file_rollup(spark, sf_dir):
    return reports.file_rollup(_results(spark, sf_dir))


@query
def file_document(spark, sf_dir):
    docs = documents.file_documents(_reused_results(spark, sf_dir), per_block=1)
    return docs.select("file_path", F.col("block").cast("bigint").alias("block"), F.md5("text").alias("digest"))


@query
def document_rows(spark, sf_dir):
    rows = documents.document_rows(_reused_results(spark, sf_dir))
    return rows.select(
        "file_path", "part", "position", F.char_length("text").cast("bigint").alias("n"), F.md5("text").alias("digest")
    )


@query
def project_document(spark, sf_dir):
    rows = _reused_results(spark, sf_dir)
    summary = reports.file_summary(rows, tables.sources(spark, sf_dir))
    return documents.project_document(rows, "parts", summary).select("part", "file_path", "text")


@query
def token_totals(spark, sf_dir):
    return reports.token_totals(_results(spark, sf_dir))


@query
def token_cost(spark, sf_dir):
    rows = chunk_rows(_written_functions(spark, sf_dir), MAX_TOKENS)
    joined = results.join_responses(rows, tables.responses(spark, sf_dir), "version")
    return reports.token_cost(joined, "tokens", "tokens_used")


@query
def run_metrics(spark, sf_dir):
    log = tables.attempts(spark, sf_dir).withColumn("latency_ms", F.col("value"))
    log = log.withColumn("tokens", F.col("user_id"))
    cached, failed = F.col("outcome") == "success", F.col("outcome") == "transient"
    metrics = reports.run_metrics(log, "latency_ms", "tokens", cached, failed)
    return metrics.select(
        *[F.round(c, 6).alias(c) if c != "total_tokens" else F.col(c) for c in metrics.columns]
    )


@query
def coverage(spark, sf_dir):
    return reports.coverage(tables.sources(spark, sf_dir), _results(spark, sf_dir))


@query
def distinct_token_counts(spark, sf_dir):
    return ck.distinct_token_counts(tables.files(spark, sf_dir), "content")


# --- windows, sorts, set operations ------------------------------------------------------------------


@query
def chunk_positions(spark, sf_dir):
    rows = explode_functions(parse_files(tables.sources(spark, sf_dir)))
    placed = ordering.with_global_position(
        rows.select("file_path", "start_line", "name", F.col("position").alias("in_file"), "function_count"),
        ["file_path", "start_line"],
    )
    return placed.select(
        "file_path", "name",
        F.col("in_file").cast("bigint").alias("in_file"),
        F.col("function_count").cast("bigint").alias("function_count"),
        "position",
    )


@query
def error_log(spark, sf_dir):
    return reports.error_log(*_analysis(spark, sf_dir)).withColumn("start_line", F.col("start_line").cast("bigint"))


@query
def first_errors(spark, sf_dir):
    parsed, rows = _analysis(spark, sf_dir)
    return reports.first_errors(reports.error_log(parsed, written(rows, "results")))


@query
def dedup_chunks(spark, sf_dir):
    rows = ck.dedup_chunks(ck.make_chunks(_functions(spark, sf_dir)))
    return rows.withColumn("start_line", F.col("start_line").cast("bigint"))


@query
def rate_slots(spark, sf_dir):
    """Every request with the limits its minute keeps: the sums of its slot are checked, not its number."""
    requests = tables.attempts(spark, sf_dir).select("event_id", F.col("user_id").alias("tokens"))
    placed = written(ordering.rate_slots(requests, ["event_id"], "tokens"), "slots")
    sums = placed.groupBy("slot").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"))
    checked = sums.select("slot", ((F.col("n") <= 500) & (F.col("total") <= 10000)).alias("within_limits"))
    return placed.join(checked, "slot").select("event_id", "tokens", "position", "within_limits", "over_limit")


@query
def oversize(spark, sf_dir):
    return ck.oversize(chunk_rows(_functions(spark, sf_dir), max_tokens=2**31 - 1), MAX_TOKENS).select(
        "file_path", "chunk_name", F.col("start_line").cast("bigint").alias("start_line"), "tokens"
    )


# --- vectors ---------------------------------------------------------------------------------------


def _vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 20, as a query against all."""
    own = tables.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _ranked(nearest):
    return nearest.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance")
    )


@query
def vector_topk(spark, sf_dir):
    table = tables.table(spark, sf_dir, "embeddings")
    return _ranked(vectors.search_many(table, _vector_queries(spark, sf_dir)))


@query
def vector_topk_filtered(spark, sf_dir):
    table = tables.table(spark, sf_dir, "embeddings")
    return _ranked(vectors.search_many(table, _vector_queries(spark, sf_dir), where=F.col("label") >= 5))


def _indexed(spark, sf_dir):
    """Vector table stored with its buckets."""
    return written(vectors.with_buckets(tables.table(spark, sf_dir, "embeddings")), "vector-index")


@query
def vector_buckets(spark, sf_dir):
    """Nearest vectors among those in the buckets that a query looks into; distances are exact."""
    return _ranked(vectors.search_buckets(_indexed(spark, sf_dir), _vector_queries(spark, sf_dir)))


@query
def vector_recall(spark, sf_dir):
    """Whether the buckets find nine of ten of the exact nearest, over all queries."""
    indexed, points = _indexed(spark, sf_dir), _vector_queries(spark, sf_dir)
    met = vectors.recall(vectors.search_many(indexed, points), vectors.search_buckets(indexed, points))
    return met.select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query
def vector_search(spark, sf_dir):
    """Nearest rows to one vector, the mean of the table."""
    table = tables.table(spark, sf_dir, "embeddings")
    center = vectors.mean_vectors(table.withColumn("all", F.lit(0)), "all").first()["query"]
    return vectors.search(table, center).select("vec_id", F.round("distance", 6).alias("distance"))


@query
def retrieval_accuracy(spark, sf_dir):
    """Share of queries with a vector of their own label among their nearest others."""
    table = tables.table(spark, sf_dir, "embeddings")
    nearest = vectors.search_many(table, _vector_queries(spark, sf_dir), vectors.TOP_K + 1).where("query_id <> vec_id")
    own = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    others = nearest.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= vectors.TOP_K)
    labels = table.select("vec_id", "label")
    labelled = others.join(labels, "vec_id").join(
        labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id"
    )
    return vectors.retrieval_accuracy(labelled, F.col("label") == F.col("wanted"))


@query
def vector_upsert(spark, sf_dir):
    """Vector table with the rows of one half of the labels replaced and others added, vectors included."""
    table = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    incoming = table.select(
        F.when(F.col("label") < 5, F.col("vec_id")).otherwise(F.col("vec_id") + 1000000).alias("vec_id"),
        (F.col("label") + 100).alias("label"),
        F.reverse("embedding").alias("embedding"),
    )
    done = snapshot.upsert(table, incoming, "vec_id")
    ends = [F.col("embedding")[i].cast("double").alias(n) for i, n in ((0, "first"), (63, "last"))]
    return done.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"), *ends)


@query
def stored_upsert(spark, sf_dir):
    """``vector_upsert`` on a stored table, of which only the parts of incoming ids are rewritten."""
    table = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    folder = new_folder(spark, "vectors")
    stored.create(table, folder, "vec_id")
    incoming = table.select(
        F.when(F.col("label") < 5, F.col("vec_id")).otherwise(F.col("vec_id") + 1000000).alias("vec_id"),
        (F.col("label") + 100).alias("label"),
        F.reverse("embedding").alias("embedding"),
    )
    stored.upsert(spark, folder, incoming)
    ends = [F.col("embedding")[i].cast("double").alias(n) for i, n in ((0, "first"), (63, "last"))]
    return stored.read(spark, folder).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"), *ends)


@query
def stored_delete(spark, sf_dir):
    """``delete_by_file`` on a stored table of chunks."""
    rows = chunk_rows(_written_functions(spark, sf_dir)).select("chunk_id", "file_path", "chunk_name")
    folder = new_folder(spark, "chunks")
    stored.create(rows, folder, "file_path")
    parts = tables.table(spark, sf_dir, "part")
    gone = parts.where(F.col("p_type") == "SMALL").select(F.expr(tables.SOURCE_PATH).alias("file_path"))
    stored.replace(spark, folder, gone)
    return stored.read(spark, folder)


@query
def run_incremental(spark, sf_dir):
    """Statistics of a run kept up over three snapshots: files are added, changed and removed, replies come later."""
    store = new_folder(spark, "store")
    now = tables.sources(spark, sf_dir).withColumn("hash", tx.content_hash(F.col("content")))
    part = F.pmod(F.xxhash64("path"), F.lit(6))
    other = F.concat("content", F.lit("\nint more(void) { return 1; }\n"))

    def altered(files, where):
        return files.withColumn("content", F.when(where, other).otherwise(F.col("content"))).withColumn(
            "hash", tx.content_hash(F.col("content"))
        )

    gone = altered(now.where(part == 5), F.lit(True)).withColumn("path", F.concat(F.lit("old/"), "path"))
    snapshots = [altered(now.where(part != 0), part == 1).unionByName(gone), altered(now, part == 2), now]
    replies = tables.responses(spark, sf_dir)
    late = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    incremental.start(spark, store)
    for files, known in zip(snapshots, (replies.where(~late), replies.where(~late), replies)):
        incremental.update(
            spark, store, files.select("path", "hash"), lambda fresh: files.join(fresh, "path", "left_semi"), known, MAX_TOKENS, "version"
        )
    return incremental.run_stats(spark, store).withColumns({c: F.round(c, 6) for c in ("error_rate", "success_rate")})


# --- streams ----------------------------------------------------------------------------------------


@query
def stream_append(spark, sf_dir):
    """Replies validated as they arrive and appended to a table."""
    stream = streams.file_stream(spark, f"{sf_dir}/part.parquet*")

    def transform(parts):
        replied = parts.where(tables.REPLIED).select(
            F.expr(tables.SOURCE_PATH).alias("file_path"),
            F.expr("concat('f', p_partkey)").alias("chunk_name"),
            F.expr(tables.F_REPLY).alias("raw_response"),
            F.expr("bigint(p_size * 10)").alias("tokens_used"),
            F.lit(True).alias("replied"),
        )
        rows = results.assemble_results(results.validate_responses(replied))
        return rows.select("file_path", "chunk_name", "status", "function_role", "tokens_used")

    return streams.append_results(stream, transform)


@query
def stream_append_csv(spark, sf_dir):
    """Replies as they arrive, appended to CSV files with a header each."""
    stream = streams.file_stream(spark, f"{sf_dir}/part.parquet*").where(tables.REPLIED)
    rows = stream.select(F.expr(tables.SOURCE_PATH).alias("file_path"), F.expr(tables.F_REPLY).alias("raw"))
    folder = new_folder(spark, "csv")
    streams.append_csv(rows, folder, new_folder(spark, "csv-log"))
    back = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return back.select("file_path", F.md5("raw").alias("digest"))


@query
def stream_dedup(spark, sf_dir):
    """Distinct event contents; all events lie within one expiry, so each shows once."""
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet*")
    keyed = stream.select(F.expr("sha2(concat(event_type, props), 256)").alias("hash"), "ts")
    return streams.dedup_results(keyed, "hash", "ts").select("hash")


# Times of prompts and replies that tables without any are given: a prompt a second, replies after up to nine minutes.
SENT = "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey)"
RECEIVED = f"{SENT} + make_dt_interval(0, 0, p_partkey % 10, 0)"
# Beyond all times in the tables.
END = "2100-01-01 00:00:00"


@query
def stream_replies(spark, sf_dir):
    """Prompts and replies as two streams; a prompt whose reply does not come within five minutes is missing one."""
    parts = streams.file_stream(spark, f"{sf_dir}/part.parquet*")
    prompts = parts.selectExpr(f"{tables.SOURCE_PATH} as file_path", "concat('f', p_partkey) as chunk_name", "p_partkey as chunk_id", f"{SENT} as sent")
    replies = parts.where(tables.REPLIED).selectExpr("p_partkey as chunk_id", f"{tables.F_REPLY} as raw_response", "bigint(p_size * 10) as tokens_used", f"{RECEIVED} as received")
    met = streams.with_replies(
        streams.closed(prompts, sent=END, chunk_id=-1), streams.closed(replies, received=END, chunk_id=-1), "chunk_id", "sent", "received"
    )
    checked = results.validate_responses(met.where(F.col("sent") < F.lit(END).cast("timestamp")))
    error = F.when(F.col("replied"), F.col("error")).otherwise(F.lit(results.NO_REPLY))
    rows = results.assemble_results(checked.withColumn("error", error))
    return streams.append_results(rows.select("file_path", "chunk_name", "status", "function_role"), lambda same: same)


# No chunk that an event belongs to.
NO_CHUNK = -(2**63)


@query
def stream_retries(spark, sf_dir):
    """Last state of each chunk's tries, all timers over: what has not succeeded by then is given up."""
    events = streams.file_stream(spark, f"{sf_dir}/events.parquet*")
    attempts = events.selectExpr("event_id div 4 as chunk_id", f"{tables.OUTCOME} as outcome", "cast(ts as timestamp) as ts")
    closed = streams.closed(attempts, chunk_id=NO_CHUNK, ts=END)
    rows = streams.append_results(streams.retry_states(closed, max_attempts=3, max_wait=3600), lambda same: same).where(F.col("chunk_id") != NO_CHUNK)
    last = F.max_by(F.struct("failures", "succeeded", "elapsed_seconds", "gave_up"), F.struct(F.col("gave_up"), "failures")).alias("last")
    return rows.groupBy("chunk_id").agg(last).select("chunk_id", F.col("last.failures").cast("bigint").alias("failures"), "last.succeeded", "last.elapsed_seconds", "last.gave_up")


@query
def stream_stats(spark, sf_dir):
    stream = streams.file_stream(spark, f"{sf_dir}/events.parquet*")
    counters = {"n": "count(*)", "tokens": "sum(user_id)"}
    return streams.running_counters(stream, "event_type", counters)


# Catalog names that would hide an imported operator carry an underscore in this module.
CATALOG = {name.rstrip("_"): function for name, function in CATALOG.items()}
