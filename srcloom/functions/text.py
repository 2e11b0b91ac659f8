"""Scalar functions over file paths and file texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes by language group, compared in lower case.
C_SUFFIXES = (".c",)
CPP_SUFFIXES = (".cpp", ".cc", ".cxx", ".c++")
HEADER_SUFFIXES = (".h", ".hpp", ".hxx", ".h++")
CPP_HEADER_SUFFIXES = (".hpp", ".hxx", ".h++")

# Fixed value: estimated tokens per character of C or C++ text.
TOKENS_PER_CHAR = 0.4

# Fixed value: characters that end a line besides carriage return.
LINE_BREAKS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def normalize_newlines(text: Column) -> Column:
    """Turn CRLF and CR into LF, as a text-mode read does."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 of the decoded text as UTF-8, in hex."""
    return F.sha2(text.cast("binary"), 256)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a path outside ``root`` is kept as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def detect_language(path: Column) -> Column:
    """'c' or 'cpp' from the suffix; an unknown suffix counts as C."""
    return F.when(suffix(path).isin(*CPP_SUFFIXES, *CPP_HEADER_SUFFIXES), F.lit("cpp")).otherwise(F.lit("c"))


def is_source_path(path: Column, include_headers: bool = True) -> Column:
    wanted = C_SUFFIXES + CPP_SUFFIXES + (HEADER_SUFFIXES if include_headers else ())
    return suffix(path).isin(*wanted)


def line_count(text: Column) -> Column:
    """Number of lines; a final line break adds none and empty text has none."""
    unified = F.regexp_replace(text, r"\r\n", "\n")
    breaks = LINE_BREAKS + "\r"
    ended = F.char_length(unified) - F.char_length(F.translate(unified, breaks, ""))
    open_tail = (unified != "") & ~F.right(unified, F.lit(1)).isin(*breaks)
    return ended + open_tail.cast("int")


def token_estimate(text: Column) -> Column:
    """Cheap token count: characters times a constant, cut to an integer."""
    return (F.char_length(text) * F.lit(TOKENS_PER_CHAR)).cast("bigint")


def token_count(text: Column, mode: str = "fast", counter: Callable[[Column], Column] | None = None) -> Column:
    """Token count by ``mode``: 'fast' estimates, 'accurate' applies the caller's counter, such as one of a tokenizer."""
    if mode == "fast":
        return token_estimate(text)
    if mode == "accurate":
        if counter is None:
            raise ValueError("mode 'accurate' needs a counter")
        return counter(text)
    raise ValueError(f"unknown token count mode: {mode}")


# The patterns of the following three define what they remove.
def remove_comments(code: Column) -> Column:
    """Drop // and /* */ comments without regard to string literals."""
    no_line = F.regexp_replace(code, r"(?md)//.*?$", "")
    return F.regexp_replace(no_line, r"(?s)/\*.*?\*/", "")


def strip_comments(code: Column) -> Column:
    """Drop comments, then directive lines."""
    return F.regexp_replace(remove_comments(code), r"(?md)^\s*#.*?$", "")


def normalize_whitespace(code: Column) -> Column:
    """Fold runs of blanks to one and drop empty lines."""
    folded = F.regexp_replace(code, r"[ \t]+", " ")
    return F.regexp_replace(folded, r"\n\s*\n", "\n")


def embedding_text(name: Column, code: Column) -> Column:
    return F.concat_ws("\n", name, code)


def id_file_part(result_id: Column) -> Column:
    """Part before the first colon of an id, or 'unknown' when there is none."""
    return F.when(F.contains(result_id, F.lit(":")), F.substring_index(result_id, ":", 1)).otherwise(
        F.lit("unknown")
    )


def list_size(items: Column) -> Column:
    """Length of a list; an absent list counts as empty."""
    return F.coalesce(F.size(items), F.lit(0))


def short_message(message: Column, limit: int = 100) -> Column:
    return F.left(message, F.lit(limit))
