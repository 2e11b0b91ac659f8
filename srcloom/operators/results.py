"""Prompts, the join with replies, validation and result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions import replies
from srcloom.functions import text as tx
from srcloom.functions.fold import settle
from srcloom.operators.ordering import with_global_position
from srcloom.operators.skew import join_unique

OK, INVALID, MISSING = "ok", "invalid", "missing"
NO_REPLY = "no reply"


@dataclass(frozen=True)
class PromptText:
    """Wording around the code and its context; callers may pass their own."""

    system: str = (
        "You explain legacy C and C++ code. Describe behavior and role only; suggest no "
        "changes. Answer with exactly one JSON object and nothing else."
    )
    head: str = "Explain what the following function does.\n\n## Code\n```c\n"
    middle: str = "\n```\n\n## Context\n"
    tail: str = (
        "\n\n## Output\nOne JSON object with the keys function_role, behavior {normal_case, "
        "special_cases[], error_cases[]}, data_flow {inputs, outputs, side_effects}, call_graph "
        "{calls[], called_by[]}, state_management, assumptions, notes."
    )
    no_context: str = "No context"


@dataclass(frozen=True)
class FailureText:
    """Markers in the result row of a reply that failed validation."""

    marker: str = "[analysis failed]"
    item: str = "could not be analyzed"
    callee: str = "analysis failed"
    assumption: str = "[analysis failed] validation error"
    note: str = "error detail: "


def prompt(code: Column, context: Column, wording: PromptText = PromptText()) -> Column:
    ctx = F.when(F.coalesce(context, F.lit("")) == "", F.lit(wording.no_context)).otherwise(context)
    return F.concat(F.lit(wording.head), code, F.lit(wording.middle), ctx, F.lit(wording.tail))


def render_prompts(chunks: DataFrame, wording: PromptText = PromptText()) -> DataFrame:
    """Add ``system_prompt`` and ``prompt`` to chunks with ``code`` and ``context``."""
    return chunks.withColumn("system_prompt", F.lit(wording.system)).withColumn(
        "prompt", prompt(F.col("code"), F.col("context"), wording)
    )


def assign_models(chunks: DataFrame, models: Sequence[str], order: list[str]) -> DataFrame:
    """Add ``request``, the number of the chunk in the given total order, and its model in turn."""
    if not models:
        raise ValueError("at least one model is needed")
    ordered = with_global_position(chunks, order, name="request")
    names = F.array(*[F.lit(m) for m in models])
    turn = ((F.col("request") - 1) % len(models)).cast("int") + 1
    return ordered.withColumn("model", F.element_at(names, turn))


def latest_replies(responses: DataFrame, version: str | None = None) -> DataFrame:
    """One validated reply per chunk id: the one with the highest version, else the most tokens.

    Without this the join below would multiply rows. The choice is made on numbers and a hash of the text, so
    no text is sorted; each task keeps one row of an id before the shuffle. Validation runs here, once per id and not once per
    copy of a chunk.
    """
    order = [F.desc(version)] if version else []
    ranked = responses.withColumn("_hash", F.xxhash64("raw"))
    first = Window.partitionBy("chunk_id").orderBy(*order, F.desc("tokens"), "_hash")
    latest = ranked.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    checked = latest.select(
        "chunk_id",
        F.coalesce("raw", F.lit("")).alias("raw"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        replies.checked_reply("coalesce(raw, '')").alias("checked"),
    )
    return settle(checked, ["chunk_id"], F.struct("raw", "tokens", "checked").alias("answer"))


def join_responses(chunks: DataFrame, responses: DataFrame, version: str | None = None) -> DataFrame:
    """Chunks with their validated reply; no reply text gives '', no usage gives 0.

    A content id with many copies is hot on the chunk side alone, the reply side has one
    row per id.
    """
    joined = join_unique(chunks, latest_replies(responses, version), "chunk_id")
    replied = F.col("answer").isNotNull()
    return joined.select(
        *chunks.columns,
        F.coalesce("answer.raw", F.lit("")).alias("raw_response"),
        F.coalesce("answer.tokens", F.lit(0).cast("bigint")).alias("tokens_used"),
        replied.alias("replied"),
        F.when(replied, F.col("answer.checked.error")).otherwise(F.lit(NO_REPLY)).alias("error"),
        F.col("answer.checked.reply").alias("reply"),
    )


def call_models(
    prompts: DataFrame, reply: Callable[[pd.Series], pd.DataFrame], key: str = "chunk_id"
) -> DataFrame:
    """Replies from a function of the caller, run on executors one Arrow batch at a time.

    ``reply`` maps a series of prompts to a frame with columns ``raw`` and ``tokens``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = reply(batch["prompt"]).reset_index(drop=True)
            yield pd.DataFrame(
                {"chunk_id": batch[key].to_numpy(), "raw": answers["raw"], "tokens": answers["tokens"]}
            )

    return prompts.select(key, "prompt").mapInPandas(run, "chunk_id string, raw string, tokens bigint")


def validate_responses(rows: DataFrame, text: str = "raw_response") -> DataFrame:
    """Add ``errors`` (failing fields), ``error`` (message) and ``reply`` (null if invalid)."""
    checked = rows.withColumn("_checked", replies.checked_reply(text))
    return checked.select(*rows.columns, "_checked.errors", "_checked.error", "_checked.reply")


def assemble_results(joined: DataFrame, markers: FailureText = FailureText()) -> DataFrame:
    """Result row per chunk with a status, from rows with a validated reply.

    A reply that fails validation keeps its row, filled with failure markers: one marker in
    each list. A chunk without a reply keeps a row too, with status 'missing'.
    """
    used = ("raw_response", "tokens_used", "replied", "errors", "error", "reply")
    failed = F.col("error").isNotNull()
    placeholders = {
        "function_role": F.concat(F.lit(markers.marker), tx.short_message(F.col("error"))),
        "behavior.special_cases": F.array(F.lit(markers.item)),
        "behavior.error_cases": F.array(F.lit(markers.item)),
        "call_graph.calls": F.array(F.lit(markers.callee)),
        "call_graph.called_by": F.array(F.lit(markers.callee)),
        "assumptions": F.lit(markers.assumption),
        "notes": F.concat(F.lit(markers.note), F.col("error")),
    }
    values = {
        f.path: F.when(failed, placeholders.get(f.path, F.lit(markers.marker))).otherwise(
            F.col(f"reply.{f.path}")
        )
        for f in replies.FIELDS
    }
    status = (
        F.when(~F.col("replied"), F.lit(MISSING)).when(failed, F.lit(INVALID)).otherwise(F.lit(OK))
    )
    return joined.select(
        *[c for c in joined.columns if c not in used],
        *replies.nested(values),
        "raw_response",
        "tokens_used",
        status.alias("status"),
        "error",
    )


def with_result(results: DataFrame) -> DataFrame:
    """Rows of chunks that got a reply, valid or not."""
    return results.where(F.col("status") != MISSING)
