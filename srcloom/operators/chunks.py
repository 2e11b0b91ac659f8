"""Chunk records, token budget, block and hybrid splits, overlap and file context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions import csource
from srcloom.functions import text as tx
from srcloom.functions.fold import bind, last_at_most, let, positions, settle, window_of, with_running_sum
from srcloom.operators.ordering import with_neighbours

# Default token budget, minimum size, context budget.
MAX_CHUNK_TOKENS = 18000
MIN_CHUNK_TOKENS = 100
CONTEXT_MAX_TOKENS = 2000
OVERLAP_LINES = 10


def make_chunks(functions: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Chunk per function: content id, type, name, code, tokens, nested metadata."""
    return functions.select(
        tx.content_hash(F.col("body")).alias("id"),
        F.lit("function").alias("type"),
        "name",
        F.col("body").alias("code"),
        (tx.token_estimate(F.col("body")) if tokens is None else tokens).alias("tokens"),
        F.struct(
            F.col("name").alias("function_name"),
            "start_line",
            "end_line",
            "line_count",
            "params",
            "return_type",
            "file_path",
            tx.file_name(F.col("file_path")).alias("file_name"),
        ).alias("metadata"),
    )


def within_budget(
    chunks: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, min_tokens: int | None = None
) -> DataFrame:
    kept = F.col("tokens") <= max_tokens
    if min_tokens is not None:
        kept = kept & (F.col("tokens") >= min_tokens)
    return chunks.where(kept)


def oversize(chunks: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS) -> DataFrame:
    """Chunks over the budget, which a run reports instead of dropping them silently."""
    return chunks.where(F.col("tokens") > max_tokens)


def budget_status(
    chunks: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, min_tokens: int = MIN_CHUNK_TOKENS
) -> DataFrame:
    return chunks.withColumn(
        "budget",
        F.when(F.col("tokens") > max_tokens, F.lit("oversize"))
        .when(F.col("tokens") < min_tokens, F.lit("small"))
        .otherwise(F.lit("kept")),
    )


def with_blocks(texts: DataFrame, text: str, max_tokens: int = MAX_CHUNK_TOKENS) -> DataFrame:
    """Add ``blocks``: the lines of a text packed greedily under a token budget.

    Running token sums over the lines let each block find its end by bisection, so a text
    costs its length once plus a few steps per block. A line over the budget is a block of
    its own; the blocks joined by line breaks give the text back.
    """
    tokens = f"bigint(floor(char_length(x) * {tx.TOKENS_PER_CHAR}D))"
    df = texts.withColumn("_lines", F.split(F.col(text), "\n", -1))
    df = bind(df, "_line_tokens", ["_lines"], f"transform(s._lines, x -> {tokens})")
    df = with_running_sum(df, "_line_tokens", "_totals")
    # Two neighbouring blocks together exceed the budget, which bounds their number.
    rounds = f"sequence(1, least(size(s._totals), int(2 * s._totals[size(s._totals) - 1] div {max_tokens} + 2)))"
    start = "a[size(a) - 1]"
    spent = f"if({start} = 0, 0L, s._totals[{start} - 1])"
    next_start = f"greatest({last_at_most('s._totals', f'{spent} + {max_tokens}')} + 1, {start} + 1)"
    df = bind(
        df,
        "_starts",
        ["_totals"],
        f"aggregate({rounds}, array(0), (a, n) -> "
        f"if({start} >= size(s._totals), a, array_append(a, {next_start})))",
    )
    block = let(
        "length",
        "s._starts[k + 1] - s._starts[k]",
        f"array_join({window_of('s._lines', 's._starts[k]', 'length')}, chr(10))",
    )
    numbers = positions("0", "(size(s._starts) - 1)")
    df = bind(df, "blocks", ["_lines", "_starts"], f"transform({numbers}, k -> {block})")
    return settle(df, texts.columns, F.col("blocks"))


def block_split(
    texts: DataFrame, key: str, text: str, max_tokens: int = MAX_CHUNK_TOKENS
) -> DataFrame:
    """One row per block: key, 1-based block number, code, tokens."""
    split = with_blocks(texts.select(key, text), text, max_tokens)
    rows = split.select(key, F.posexplode("blocks").alias("pos", "code"))
    return rows.select(
        key, (F.col("pos") + 1).alias("block"), "code", tx.token_estimate(F.col("code")).alias("tokens")
    )


def hybrid_split(functions: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS) -> DataFrame:
    """Functions under the budget as they are, larger ones as ``name_partN`` rows."""
    sized = functions.select(
        "file_path", "name", "start_line", "body", tx.token_estimate(F.col("body")).alias("tokens")
    )
    large = F.col("tokens") > max_tokens
    sized = sized.withColumn("_large_body", F.when(large, F.col("body")))
    split = with_blocks(sized, "_large_body", max_tokens).select(
        "file_path",
        "name",
        "start_line",
        large.alias("large"),
        F.posexplode(F.when(large, F.col("blocks")).otherwise(F.array("body"))).alias("pos", "code"),
    )
    part = F.concat("name", F.lit("_part"), (F.col("pos") + 1).cast("string"))
    return split.select(
        "file_path",
        "start_line",
        F.when(F.col("large"), F.lit("function_part")).otherwise(F.lit("function")).alias("type"),
        F.when(F.col("large"), part).otherwise(F.col("name")).alias("name"),
        F.when(F.col("large"), F.col("name")).alias("parent"),
        (F.col("pos") + 1).alias("part"),
        "code",
        tx.token_estimate(F.col("code")).alias("tokens"),
    )


def overlap_functions(
    parsed: DataFrame, lines: int = OVERLAP_LINES, ratio: float | None = None
) -> DataFrame:
    """Functions with the last lines of the one before and the first of the one after.

    ``ratio`` takes a share of the neighbour's lines instead of a fixed number. Neighbours
    are read from the functions array of the file's own row.
    """

    def taken(body: str) -> str:
        count = f"size({body})"
        return f"int(ceil({count} * {ratio}D))" if ratio is not None else f"least({count}, {lines})"

    def edge(index: str, last: bool) -> str:
        body = f"split(s.functions[{index}].body, chr(10), -1)"
        first = f"size(n) - {taken('n')}" if last else "0"
        return let("n", body, f"array_join({window_of('n', f'({first})', taken('n'))}, chr(10))")

    none = lines == 0 if ratio is None else ratio == 0
    before = "cast(null as string)" if none else f"case when i > 0 then {edge('i - 1', True)} end"
    after = (
        "cast(null as string)"
        if none
        else f"case when i < size(s.functions) - 1 then {edge('i + 1', False)} end"
    )
    body = (
        "transform(s.functions, (f, i) -> named_struct('name', f.name, 'start_line', f.start_line, "
        f"'code', concat_ws(chr(10), {before}, f.body, {after})))"
    )
    rows = bind(parsed.select("path", "functions"), "overlapped", ["functions"], body)
    rows = settle(rows, ["path"], F.col("overlapped"))
    return rows.select(F.col("path").alias("file_path"), F.explode("overlapped").alias("f")).select(
        "file_path", "f.*", tx.token_estimate(F.col("f.code")).alias("tokens")
    )


def overlap_parts(parts: DataFrame, file: str, order: list[str], code: str = "code", lines: int = OVERLAP_LINES) -> DataFrame:
    """Parts of split files or functions as rows, each with the last lines of the one before it in the file and the
    first lines of the one behind it around its ``code``; tokens are those of the whole."""
    cut = F.split(F.col(code), "\n", -1)
    last = F.array_join(F.slice(cut, -F.least(F.size(cut), F.lit(lines)), F.lit(lines)), "\n")
    first = F.array_join(F.slice(cut, 1, lines), "\n")
    near = with_neighbours(parts, file, order, last, first)
    whole = F.concat_ws("\n", "before", code, "after")
    kept = [c for c in parts.columns if c not in (code, "tokens")]
    return near.select(*kept, whole.alias(code)).withColumn("tokens", tx.token_estimate(F.col(code)))


def with_file_context(parsed: DataFrame, max_tokens: int = CONTEXT_MAX_TOKENS) -> DataFrame:
    """Add ``context``: includes and macro names of the file, whole lines within the context budget, and
    ``context_truncated`` where lines were left out."""
    lines = F.concat(
        F.transform(csource.include_names(F.col("content")), lambda n: F.concat(F.lit("#include "), n)),
        F.transform(csource.macro_names(F.col("content")), lambda n: F.concat(F.lit("#define "), n)),
    )
    limit = int(max_tokens / tx.TOKENS_PER_CHAR)
    whole = F.array_join(lines, "\n")
    # Up to the last line break within the limit and the character behind it.
    kept = F.regexp_extract(F.left(whole, F.lit(limit + 1)), r"(?s)^(.*)\n", 1)
    fits = F.char_length(whole) <= limit
    return parsed.withColumn("context", F.when(fits, whole).otherwise(kept)).withColumn("context_truncated", ~fits)


def chunk_context(parsed: DataFrame, max_tokens: int = CONTEXT_MAX_TOKENS) -> DataFrame:
    """Chunks with the context of their file, taken from the file's own row."""
    with_context = parsed if "context" in parsed.columns else with_file_context(parsed, max_tokens)
    rows = with_context.select(
        F.col("path").alias("file_path"), "context", "context_truncated", F.explode("functions").alias("f")
    )
    return rows.select(
        tx.content_hash(F.col("f.body")).alias("id"),
        F.col("f.name").alias("name"),
        "file_path",
        F.col("f.start_line").alias("start_line"),
        F.col("f.body").alias("code"),
        "context",
        "context_truncated",
    )


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Of each content id the chunk of the smallest path and line, which a prompt is made of.

    Each task keeps one row of an id before the shuffle.
    """
    first = Window.partitionBy("id").orderBy("file_path", "start_line")
    return chunks.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def extract_includes(files: DataFrame) -> DataFrame:
    names = F.posexplode(csource.include_names(F.col("content"))).alias("pos", "include")
    return files.select("path", names).select("path", (F.col("pos") + 1).alias("position"), "include")


def extract_macros(files: DataFrame) -> DataFrame:
    names = F.posexplode(csource.macro_names(F.col("content"))).alias("pos", "macro")
    return files.select("path", names).select("path", (F.col("pos") + 1).alias("position"), "macro")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One row per content id, kept from the smallest path and line.

    Chunks of one id share their code, so any of the copies will do; the aggregate combines
    on the map side, so a text with many copies reaches the shuffle once per task.
    """
    where = F.struct("metadata.file_path", "metadata.start_line", "name")
    kept = chunks.groupBy("id").agg(
        F.min(where).alias("kept"), F.any_value("tokens").alias("tokens"), F.count("*").alias("copies")
    )
    return kept.select(
        "id", F.col("kept.name").alias("name"), F.col("kept.file_path").alias("file_path"),
        F.col("kept.start_line").alias("start_line"), "tokens", "copies",
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, sum, integer mean, least and most tokens; zeros for no chunks."""
    zero = F.lit(0).cast("bigint")
    n, total = F.count("*"), F.coalesce(F.sum("tokens"), zero)
    sums = chunks.agg(
        n.alias("total_chunks"),
        total.alias("total_tokens"),
        F.coalesce(F.min("tokens"), zero).alias("min_tokens"),
        F.coalesce(F.max("tokens"), zero).alias("max_tokens"),
    )
    mean = F.expr("case when total_chunks = 0 then 0L else total_tokens div total_chunks end")
    return sums.select("total_chunks", "total_tokens", mean.alias("avg_tokens"), "min_tokens", "max_tokens")


def distinct_token_counts(texts: DataFrame, text: str) -> DataFrame:
    """Each distinct text once: hash, tokens, and how often it occurred."""
    # Only hash and length travel; tokens follow from the length, once per distinct text.
    hashed = texts.select(tx.content_hash(F.col(text)).alias("hash"), F.char_length(F.col(text)).alias("_chars"))
    counted = hashed.groupBy("hash").agg(F.any_value("_chars").alias("_chars"), F.count("*").alias("occurrences"))
    tokens = F.floor(F.col("_chars") * F.lit(tx.TOKENS_PER_CHAR)).cast("bigint")
    return counted.select("hash", tokens.alias("tokens"), "occurrences")
