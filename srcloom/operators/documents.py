"""File and project documents as ordered text rows.

A document of unlimited size is never one cell: a file's document comes in blocks of a
fixed number of functions, the project document as one row per file. Read in order, the
rows are the whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.operators.reports import project_summary
from srcloom.operators.results import with_result

FUNCTIONS_PER_BLOCK = 500


@dataclass(frozen=True)
class DocumentText:
    """Wording of the documents; callers may pass their own."""

    path: str = "Path"
    language: str = "Language"
    function_count: str = "Functions"
    functions: str = "Functions"
    role: str = "Role"
    behavior: str = "Behavior"
    normal_case: str = "Normal case"
    special_cases: str = "Special cases"
    error_cases: str = "Error cases"
    data_flow: str = "Data flow"
    inputs: str = "Inputs"
    outputs: str = "Outputs"
    side_effects: str = "Side effects"
    calls: str = "Calls"
    called_by: str = "Expected callers"
    state_management: str = "State management"
    assumptions: str = "Assumptions"
    notes: str = "Notes"
    footer: str = "*Generated document.*"
    title: str = "technical document"
    overview: str = "Overview"
    files: str = "Files"
    no_issues: str = "No critical issues found."


def _bullets(heading: str, items: Column, quote: str = "") -> Column:
    """Heading and one bullet per item; nothing for an empty list."""
    lines = F.transform(items, lambda x: F.concat(F.lit(f"- {quote}"), x, F.lit(f"{quote}\n")))
    return F.when(
        tx.list_size(items) > 0, F.concat(F.lit(f"{heading}\n"), F.array_join(lines, ""), F.lit("\n"))
    ).otherwise(F.lit(""))


def _paragraph(heading: str, text: Column) -> Column:
    return F.when(
        F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"#### {heading}\n"), text, F.lit("\n\n"))
    ).otherwise(F.lit(""))


def function_section(w: DocumentText = DocumentText()) -> Column:
    """Text of one function; empty lists and fields leave their part out."""
    behavior, flow, graph = "behavior", "data_flow", "call_graph"
    return F.concat(
        F.lit("### `"), F.col("chunk_name"), F.lit("`\n\n"),
        F.lit(f"#### {w.role}\n"), F.col("function_role"), F.lit("\n\n"),
        F.lit(f"#### {w.behavior}\n\n**{w.normal_case}**: "), F.col(f"{behavior}.normal_case"), F.lit("\n\n"),
        _bullets(f"**{w.special_cases}**:", F.col(f"{behavior}.special_cases")),
        _bullets(f"**{w.error_cases}**:", F.col(f"{behavior}.error_cases")),
        F.lit(f"#### {w.data_flow}\n\n**{w.inputs}**: "), F.col(f"{flow}.inputs"),
        F.lit(f"\n\n**{w.outputs}**: "), F.col(f"{flow}.outputs"),
        F.lit(f"\n\n**{w.side_effects}**: "), F.col(f"{flow}.side_effects"), F.lit("\n\n"),
        _bullets(f"#### {w.calls}", F.col(f"{graph}.calls"), "`"),
        _bullets(f"#### {w.called_by}", F.col(f"{graph}.called_by"), "`"),
        _paragraph(w.state_management, F.col("state_management")),
        _paragraph(w.assumptions, F.col("assumptions")),
        _paragraph(w.notes, F.col("notes")),
        F.lit("---\n\n"),
    )


def _header(path: Column, count: Column | None, w: DocumentText) -> Column:
    counted = (
        [F.lit(f"**{w.function_count}**: "), count.cast("string"), F.lit("\n")] if count is not None else []
    )
    return F.concat(
        F.lit("# "), tx.file_name(path), F.lit(f"\n\n**{w.path}**: `"), path,
        F.lit(f"`\n**{w.language}**: "), tx.detect_language(path), F.lit("\n"),
        *counted,
        F.lit(f"\n---\n\n## {w.functions}\n\n"),
    )


def file_documents(
    results: DataFrame, wording: DocumentText = DocumentText(), per_block: int = FUNCTIONS_PER_BLOCK
) -> DataFrame:
    """Document of each file as ordered blocks: file_path, block, text.

    Block 0 is the header with the file's function count, the last one the footer; those
    between collect at most ``per_block`` sections each, however many functions a file has.
    Header and footer come from the counts alone, so no text takes part in a join.
    """
    found = with_result(results)
    number = F.floor((F.col("position") - 1) / F.lit(per_block)).cast("int") + 1
    sections = found.select(
        "file_path", number.alias("block"), "position", function_section(wording).alias("text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    body = sections.groupBy("file_path", "block").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text")
    )
    counts = found.groupBy("file_path").agg(F.count("*").alias("n"), F.max(number).alias("last"))
    path = F.col("file_path")
    head = counts.select(path, F.lit(0).alias("block"), _header(path, F.col("n"), wording).alias("text"))
    foot = counts.select(
        path, (F.col("last") + 1).alias("block"), F.lit(f"\n{wording.footer}\n").alias("text")
    )
    return head.unionByName(body).unionByName(foot)


def document_rows(results: DataFrame, wording: DocumentText = DocumentText()) -> DataFrame:
    """Incremental form: a header row, a row per function and a footer row per file.

    It needs no count up front, so its header has none; rows sort by file_path, part,
    position.
    """
    found = with_result(results)
    part = lambda n: F.lit(n).alias("part")
    paths = found.select("file_path").distinct()
    zero = F.lit(0).alias("position")
    head = paths.select("file_path", part(0), zero, _header(F.col("file_path"), None, wording).alias("text"))
    body = found.select("file_path", part(1), "position", function_section(wording).alias("text"))
    foot = paths.select("file_path", part(2), zero, F.lit(f"\n---\n\n{wording.footer}\n").alias("text"))
    return head.unionByName(body).unionByName(foot)


def project_document(
    results: DataFrame, project: str, summary: DataFrame, wording: DocumentText = DocumentText()
) -> DataFrame:
    """Project document: totals, a row per file of ``summary``, closing; sort by part, file_path."""
    totals = project_summary(results)
    none = F.lit("").alias("file_path")
    head = totals.select(
        F.lit(0).alias("part"),
        none,
        F.concat(
            F.lit(f"# {project} {wording.title}\n\n## {wording.overview}\n\n- total_files: "),
            F.col("total_files").cast("string"), F.lit("\n- total_functions: "),
            F.col("total_functions").cast("string"), F.lit("\n- total_lines: "),
            F.col("total_lines").cast("string"), F.lit("\n- avg_complexity: "),
            F.col("avg_complexity"), F.lit("\n- total_tokens: "),
            F.col("total_tokens").cast("string"),
            F.lit(f"\n\n## {wording.files}\n\n| name | functions | lines | path |\n|---|---|---|---|\n"),
        ).alias("text"),
    )
    rows = summary.select(
        F.lit(1).alias("part"),
        "file_path",
        F.concat(
            F.lit("| ["), F.col("name"), F.lit("](files/"), F.col("file_path"), F.lit(".md) | "),
            F.col("function_count").cast("string"), F.lit(" | "),
            F.col("total_lines").cast("string"), F.lit(" | `"), F.col("file_path"), F.lit("` |\n"),
        ).alias("text"),
    )
    foot = totals.select(
        F.lit(2).alias("part"), none, F.lit(f"\n{wording.no_issues}\n\n---\n\n{wording.footer}\n").alias("text")
    )
    return head.unionByName(rows).unionByName(foot)
