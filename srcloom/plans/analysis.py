"""A whole run: files to functions, chunks, results and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.operators import chunks as ck
from srcloom.operators import documents, reports
from srcloom.operators.functions_table import explode_functions, parse_files, rejected_blocks
from srcloom.operators.results import PromptText, assemble_results, call_models, join_responses, render_prompts
from srcloom.session import written
from srcloom.sources import sinks
from srcloom.sources.files import list_files, load_files, plain_root, scan_files, unread_files


def chunk_rows(functions: DataFrame, max_tokens: int = ck.MAX_CHUNK_TOKENS) -> DataFrame:
    """Flat chunk rows within the budget, keyed by file path and start line; without ``code`` where functions come
    without their text."""
    if "body" in functions.columns:
        text = F.col("body")
        functions = functions.withColumns({"chunk_id": tx.content_hash(text), "tokens": tx.token_estimate(text), "code": text})
    code = ["code"] if "code" in functions.columns else []
    rows = functions.select(
        "chunk_id",
        F.col("name").alias("chunk_name"),
        "file_path",
        "start_line",
        "end_line",
        "line_count",
        "position",
        *code,
        "tokens",
    )
    return ck.within_budget(rows, max_tokens)


def analyze(
    files: DataFrame, responses: DataFrame, max_tokens: int = ck.MAX_CHUNK_TOKENS, version: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parsed files and result rows."""
    parsed = parse_files(files)
    return parsed, analyze_parsed(parsed, responses, max_tokens, version)


def analyze_parsed(
    parsed: DataFrame, responses: DataFrame, max_tokens: int = ck.MAX_CHUNK_TOKENS, version: str | None = None
) -> DataFrame:
    """Result rows of parsed files. Code leaves the rows before the join with the replies."""
    rows = chunk_rows(explode_functions(parsed), max_tokens).drop("code")
    return assemble_results(join_responses(rows, responses, version))


def prompts_of(parsed: DataFrame, max_tokens: int = ck.MAX_CHUNK_TOKENS, wording: PromptText = PromptText()) -> DataFrame:
    """A prompt per content id within the budget: chunk_id, file_path, start_line, system_prompt, prompt,
    context_truncated. ``parsed`` has the content or the context of its files."""
    chunks = ck.chunk_context(parsed).where(tx.token_estimate(F.col("code")) <= max_tokens)
    rows = render_prompts(ck.distinct_chunks(chunks), wording)
    return rows.select(
        F.col("id").alias("chunk_id"), "file_path", "start_line", "system_prompt", "prompt", "context_truncated"
    )


def check_single(responses: DataFrame) -> None:
    """Refuse several replies to one content id where no version tells which is meant."""
    twice = responses.groupBy("chunk_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several replies for {twice[0][0]}; name the version column")


@dataclass(frozen=True)
class Run:
    """Tables of a finished run."""

    parsed: DataFrame
    prompts: DataFrame
    results: DataFrame
    outcomes: DataFrame
    stats: DataFrame
    verdict: DataFrame
    summary: DataFrame
    errors: DataFrame
    oversize: DataFrame
    rejects: DataFrame
    unread: DataFrame


def run(
    spark: SparkSession,
    root: str,
    responses: DataFrame | Callable[[pd.Series], pd.DataFrame],
    out: str,
    project: str,
    max_tokens: int = ck.MAX_CHUNK_TOKENS,
    include_headers: bool = True,
    version: str | None = None,
    document_per_file: bool = False,
) -> Run:
    """Analyze a directory and write its tables, reports and documents below ``out``.

    ``responses`` is a table (chunk_id, raw, tokens) of replies to the prompts, with a column ``version`` if an
    id has several, or a function from a series of prompts to a frame with ``raw`` and ``tokens``. Files, prompts
    and results are written once in the shared folder and read back, so the reports neither parse again nor
    depend on executors that held a cache. Files that cannot be read are listed and skipped. ``document_per_file``
    writes a folder with a document for each file besides.
    """
    base = plain_root(spark, root)
    relative = tx.relative_path(F.col("path"), base).alias("path")
    listed = list_files(spark, root, include_headers).select(relative, "length")
    files = load_files(scan_files(spark, root, include_headers), root)
    parsed = written(ck.with_file_context(parse_files(files)).drop("content"), "parsed")
    prompts = written(prompts_of(parsed, max_tokens), "prompts")
    if not isinstance(responses, DataFrame):
        responses = written(call_models(prompts, responses), "replies")
    elif version is None:
        check_single(responses)
    chunks = chunk_rows(explode_functions(parsed), 2**31 - 1)
    results = written(analyze_parsed(parsed, responses, max_tokens, version), "results")

    outcomes = reports.file_outcome(parsed, results)
    summary = reports.file_summary(results, parsed)
    stats = reports.run_stats(outcomes)
    done = Run(
        parsed, prompts, results, outcomes, stats, reports.quality_gate(stats), summary,
        reports.error_log(parsed, results), ck.oversize(chunks, max_tokens).drop("code"), rejected_blocks(parsed),
        unread_files(parsed, listed),
    )
    sinks.write_csv(reports.functions_table(results), f"{out}/metrics/functions")
    sinks.write_csv(reports.metrics_long(results), f"{out}/metrics/metrics")
    for name in ("outcomes", "stats", "verdict", "errors", "oversize", "rejects", "unread"):
        sinks.write_csv(getattr(done, name), f"{out}/run/{name}")
    sinks.write_json(sinks.results_json(results).select("json"), f"{out}/results")
    texts = documents.file_documents(results)
    sinks.write_documents(texts, f"{out}/files", ["file_path", "block"])
    if document_per_file:
        sinks.write_documents(texts, f"{out}/documents", ["file_path", "block"], by_file=True)
    sinks.write_documents(
        documents.project_document(results, project, summary), f"{out}/project", ["part", "file_path"]
    )
    return done
