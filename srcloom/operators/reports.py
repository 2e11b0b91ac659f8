"""Function, metric, file, project and run tables from result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.operators.results import INVALID, MISSING, OK, with_result

ERROR_RATE_LIMIT = 0.05
ERRORS_SHOWN = 10
NO_COMPLEXITY = "N/A"


def rate(part: Column, whole: Column) -> Column:
    """Share of a whole; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def functions_table(results: DataFrame) -> DataFrame:
    """One row per analyzed function with the lengths of its lists."""
    file = F.when(F.contains("chunk_id", F.lit(":")), tx.id_file_part(F.col("chunk_id"))).otherwise(
        F.coalesce("file_path", F.lit("unknown"))
    )
    return with_result(results).select(
        file.alias("file"),
        F.col("chunk_name").alias("function"),
        F.col("function_role").alias("role"),
        tx.list_size(F.col("call_graph.calls")).alias("calls"),
        tx.list_size(F.col("call_graph.called_by")).alias("callers"),
        tx.list_size(F.col("behavior.special_cases")).alias("special_cases"),
        tx.list_size(F.col("behavior.error_cases")).alias("error_cases"),
        F.col("tokens_used").alias("tokens"),
    )


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def project_summary(results: DataFrame) -> DataFrame:
    """One row of project totals; ``approx_lines`` is the token sum."""
    found = with_result(results)
    tokens = _sum(F.col("tokens_used"))
    return found.agg(
        F.countDistinct("file_path").alias("total_files"),
        F.count("*").alias("total_functions"),
        _sum(F.col("line_count")).alias("total_lines"),
        tokens.alias("approx_lines"),
        tokens.alias("total_tokens"),
    ).withColumn("avg_complexity", F.lit(NO_COMPLEXITY))


def metrics_long(results: DataFrame) -> DataFrame:
    """Six metric rows in long form.

    Case counts include the one marker per list that a failed reply leaves.
    """
    found = with_result(results)
    wide = found.agg(
        F.countDistinct("file_path").alias("total_files"),
        F.count("*").alias("total_functions"),
        _sum(F.col("tokens_used")).alias("total_lines"),
        _sum(tx.list_size(F.col("behavior.error_cases"))).alias("error_cases"),
        _sum(tx.list_size(F.col("behavior.special_cases"))).alias("special_cases"),
        _sum(F.col("tokens_used")).alias("total_tokens"),
    )
    long = wide.unpivot([], wide.columns, "metric", "value")
    category = (
        F.when(F.col("metric").isin("error_cases", "special_cases"), F.lit("quality"))
        .when(F.col("metric") == "total_tokens", F.lit("tokens"))
        .otherwise(F.lit("project"))
    )
    return long.select(category.alias("category"), "metric", "value")


def file_summary(results: DataFrame, files: DataFrame) -> DataFrame:
    """Functions, tokens and lines per file that has a result."""
    per_file = with_result(results).groupBy("file_path").agg(
        F.count("*").alias("function_count"), _sum(F.col("tokens_used")).alias("total_tokens")
    )
    lines = files.select(F.col("path").alias("file_path"), F.col("line_count").alias("total_lines"))
    return per_file.join(lines, "file_path").select(
        "file_path",
        tx.file_name(F.col("file_path")).alias("name"),
        "function_count",
        F.col("total_tokens").alias("approx_lines"),
        "total_lines",
        "total_tokens",
    )


def file_rollup(results: DataFrame) -> DataFrame:
    """Per-file sums and the project total, whose path is null."""
    return with_result(results).rollup("file_path").agg(
        F.count("*").alias("function_count"),
        _sum(F.col("tokens_used")).alias("total_tokens"),
        F.grouping("file_path").cast("int").alias("is_total"),
    )


def file_outcome(files: DataFrame, results: DataFrame) -> DataFrame:
    """Success or failure per file with a reason and its chunk counters.

    ``files`` are parsed files; the results are reduced to a row per file before the join.
    A file without any result has failed.
    """
    missing = F.col("status") == MISSING
    seen = results.groupBy(F.col("file_path").alias("path")).agg(
        F.count("*").alias("chunks"),
        F.count_if(~missing).alias("successful_chunks"),
        F.count_if(missing).alias("failed_chunks"),
        F.count_if(F.col("status") == INVALID).alias("invalid_chunks"),
        _sum(F.when(~missing, F.col("tokens_used"))).alias("total_tokens"),
    )
    counters = [c for c in seen.columns if c != "path"]
    # Only the number of functions meets the results, not their text.
    found = files.select("path", F.size("functions").alias("found"), "parse_error").join(seen, "path", "left")
    ok = F.coalesce(F.col("successful_chunks") > 0, F.lit(False))
    reason = (
        F.when(ok, F.lit(""))
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.col("found") == 0, F.lit("no functions"))
        .when(F.col("chunks").isNull(), F.lit("no chunks"))
        .otherwise(F.lit("all chunks failed"))
    )
    return found.select(
        "path",
        F.when(ok, F.lit("successful")).otherwise(F.lit("failed")).alias("outcome"),
        reason.alias("reason"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counters],
    )


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row of run counters. A reply that failed validation counts as a success here."""
    sums = outcomes.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("outcome") == "successful").alias("successful_files"),
        F.count_if(F.col("outcome") == "failed").alias("failed_files"),
        _sum(F.col("chunks")).alias("total_chunks"),
        _sum(F.col("successful_chunks")).alias("successful_chunks"),
        _sum(F.col("failed_chunks")).alias("failed_chunks"),
        _sum(F.col("invalid_chunks")).alias("invalid_chunks"),
        _sum(F.col("total_tokens")).alias("total_tokens"),
    )
    error_rate = rate(F.col("failed_chunks"), F.col("total_chunks"))
    return sums.withColumn("error_rate", error_rate).withColumn(
        "success_rate", F.lit(1.0) - F.col("error_rate")
    )


def quality_gate(stats: DataFrame, limit: float = ERROR_RATE_LIMIT) -> DataFrame:
    """Verdict of a run: too many failed chunks or none at all fail it."""
    high = F.col("error_rate") > limit
    empty = F.col("total_chunks") == 0
    reason = (
        F.when(high, F.lit("error rate exceeds limit"))
        .when(empty, F.lit("no chunks analyzed"))
        .otherwise(F.lit(""))
    )
    return stats.select(
        "total_chunks",
        "failed_chunks",
        F.round("error_rate", 6).alias("error_rate"),
        F.when(high | empty, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict"),
        reason.alias("reason"),
    )


def token_totals(results: DataFrame) -> DataFrame:
    """Tokens of valid replies alone and of all replies."""
    return results.agg(
        _sum(F.when(F.col("status") == OK, F.col("tokens_used"))).alias("analyzer_tokens"),
        _sum(F.when(F.col("status") != MISSING, F.col("tokens_used"))).alias("run_tokens"),
    )


def token_cost(
    prompts: DataFrame,
    input_tokens: str,
    output_tokens: str,
    input_price: float = 0.01,
    output_price: float = 0.03,
) -> DataFrame:
    """Token sums and cost; prices are per thousand tokens."""
    sums = prompts.agg(
        _sum(F.col(input_tokens)).alias("input_tokens"), _sum(F.col(output_tokens)).alias("output_tokens")
    )
    cost_in = F.col("input_tokens") / 1000 * input_price
    cost_out = F.col("output_tokens") / 1000 * output_price
    return sums.withColumn("cost", F.round(cost_in + cost_out, 4))


def run_metrics(attempts: DataFrame, latency: str, tokens: str, cached: Column, failed: Column) -> DataFrame:
    """Mean latency, tokens, cache hit rate and error rate."""
    return attempts.agg(
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency_ms"),
        _sum(F.col(tokens)).alias("total_tokens"),
        rate(F.count_if(cached), F.count("*")).alias("cache_hit_rate"),
        rate(F.count_if(failed), F.count("*")).alias("error_rate"),
    )


def coverage(files: DataFrame, results: DataFrame) -> DataFrame:
    """Lines of analyzed functions over lines of all files, in one aggregate over both."""
    zero = F.lit(0).cast("bigint")
    lines = F.col("line_count").cast("bigint")
    done = results.where(F.col("status") == OK).select(lines.alias("analyzed"), zero.alias("whole"))
    whole = files.select(zero.alias("analyzed"), lines.alias("whole"))
    sums = done.unionByName(whole).agg(
        _sum(F.col("analyzed")).alias("analyzed_lines"), _sum(F.col("whole")).alias("total_lines")
    )
    return sums.withColumn("coverage", F.round(rate(F.col("analyzed_lines"), F.col("total_lines")), 6))


def error_log(files: DataFrame, results: DataFrame) -> DataFrame:
    """Errors of unparsed files and of chunks without a reply, worded by their kind."""
    name = tx.file_name(F.col("path"))
    broken = F.col("parse_error") == "unbalanced braces"
    kind = F.when(broken, F.lit("parse")).otherwise(F.lit("unexpected"))
    prefix = F.when(broken, F.lit(": Parse error - ")).otherwise(F.lit(": Unexpected error - "))
    by_file = files.where(F.col("parse_error").isNotNull()).select(
        kind.alias("kind"),
        F.col("path").alias("file_path"),
        F.lit(0).alias("start_line"),
        F.concat(name, prefix, F.col("parse_error")).alias("message"),
    )
    file = tx.file_name(F.col("file_path"))
    by_chunk = results.where(F.col("status") == MISSING).select(
        F.lit("chunk").alias("kind"),
        "file_path",
        "start_line",
        F.concat(file, F.lit(":"), F.col("chunk_name"), F.lit(" - no reply")).alias("message"),
    )
    return by_file.unionByName(by_chunk)


def first_errors(errors: DataFrame, shown: int = ERRORS_SHOWN) -> DataFrame:
    """First errors in path order and one row for the rest, as a run's closing report."""
    first = errors.orderBy("file_path", "start_line", "message").limit(shown).select("message")
    more = errors.agg(F.count("*").alias("n")).where(F.col("n") > shown)
    rest = F.concat(F.lit("... and "), (F.col("n") - shown).cast("string"), F.lit(" more"))
    return first.unionByName(more.select(rest.alias("message")))
