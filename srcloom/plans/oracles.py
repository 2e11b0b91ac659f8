"""DuckDB SQL for the query catalog.

Each text is built from common table expressions; only those a query needs are included.
The function recipe here is another one than the engine's: it blanks literals, comments
and directives in place and finds the blocks with window functions over text positions.
"""

from __future__ import annotations

import re

from srcloom.functions.cscan import CONTROL_WORDS, QUALIFIER_WORDS, STORAGE_WORDS, TYPE_WORDS
from srcloom.functions.replies import FIELDS, OBJECT_FIELDS
from srcloom.functions.text import CPP_HEADER_SUFFIXES, CPP_SUFFIXES, C_SUFFIXES, HEADER_SUFFIXES
from srcloom.operators.documents import DocumentText
from srcloom.operators.results import FailureText, PromptText
from srcloom.plans import catalog as q
from srcloom.plans import tables as t

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bc_\w+", sql):
        if name not in found:
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)
    return found


def oracle(name: str, sql: str) -> None:
    ctes = ", ".join(f"{n} as ({CTES[n]})" for n in _needed(sql, []))
    ORACLES[name] = f"with {ctes} {sql}" if ctes else sql


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _text(value: str) -> str:
    """SQL text literal; line breaks are spelled with chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


# --- scalars ------------------------------------------------------------------------------
TOKENS = "cast(floor(length({0}) * cast(0.4 as double)) as bigint)"
LINES = (
    "case when {0} = '' then 0 else length({0}) - length(replace({0}, chr(10), '')) "
    "+ case when right({0}, 1) = chr(10) then 0 else 1 end end"
)
SUFFIX = "lower(regexp_extract(string_split({0}, '/')[-1], '^.+(\\.[^.]+)$', 1))"
CPP = _in(CPP_SUFFIXES + CPP_HEADER_SUFFIXES)
LANGUAGE = "case when " + SUFFIX + f" in {CPP} then 'cpp' else 'c' end"
NAME = "string_split({0}, '/')[-1]"
NO_COMMENTS = (
    r"regexp_replace(regexp_replace({0}, '(?m)//.*?$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
)
STRIPPED = "regexp_replace(" + NO_COMMENTS + r", '(?m)^\s*#.*?$', '', 'g')"

# --- derived tables --------------------------------------------------------------------------
CTES["c_files"] = (
    f"select doc_id, source, lang, {t.DOCUMENT_PATH} as path, text as content from documents"
)
CTES["c_sources"] = f"select {t.SOURCE_PATH} as path, {t.SOURCE_TEXT} as content from part"
CTES["c_responses"] = f"""
    select sha256({t.F_BODY}) as chunk_id, {t.F_REPLY} as raw, cast(p_size * 10 as bigint) as tokens, 1 as version
    from part where {t.REPLIED}
    union all
    select sha256({t.G_BODY}), case v when 1 then 'stale' else {t.G_REPLY} end,
        cast(case v when 1 then 99 else 20 end as bigint), v
    from (select distinct p_size from part) s, (values (1), (2)) as versions(v)"""
CTES["c_attempts"] = f"select event_id // 4 as chunk_id, {t.OUTCOME} as outcome, ts, value, user_id, event_id from events"

# --- functions: blank, cut at braces and semicolons, find islands by depth ---------------------
_LITERALS = (
    r"""(?s)"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|//[^\n]*|/\*.*?\*/|[^"''/]+|."""
)
_HEAD = r"\b([A-Za-z_]\w*)\s*\(([^(){};]*(?:\([^(){}]*\)[^(){};]*)*)\)\s*$"
CTES["c_blanked"] = rf"""
    select path, content, array_to_string(list_transform(
        regexp_extract_all(content, '{_LITERALS}'),
        lambda x: case when x[1:1] in ('"', '''') or x[1:2] in ('//', '/*')
            then regexp_replace(x, '[^\n]', ' ', 'g') else x end), '') as text
    from c_sources where {LANGUAGE.format('path')} = 'c'"""
CTES["c_code"] = r"""
    select path, content, array_to_string(list_transform(
        regexp_extract_all(text, '(?m)^[ \t]*#(?:\\\n|[^\n])*|[^\n]+|\n'),
        lambda x: case when ltrim(x, chr(9) || ' ')[1:1] = '#' then regexp_replace(x, '[^\n]', ' ', 'g') else x end),
        '') as code
    from c_blanked"""
CTES["c_cuts"] = r"""
    select path, unnest(cuts) as cut, generate_subscripts(cuts, 1) as i
    from (select path, regexp_extract_all(code, '[^{};]*[{};]') as cuts from c_code)"""
CTES["c_depths"] = """
    select path, i, cut, right(cut, 1) as mark,
        sum(length(cut)) over w as stop,
        sum(case right(cut, 1) when '{' then 1 when '}' then -1 else 0 end) over w as depth
    from c_cuts window w as (partition by path order by i)"""
CTES["c_islands"] = """
    select *, coalesce(sum(case when depth = 0 then 1 else 0 end)
        over (partition by path order by i rows between unbounded preceding and 1 preceding), 0) as island
    from c_depths"""
CTES["c_open"] = """
    select c.path, coalesce(d.depth, 0) as open_depth from c_code c
    left join (select path, arg_max(depth, i) as depth from c_depths group by path) d on c.path = d.path"""
CTES["c_blocks"] = """
    select path, min(stop - length(cut)) as start, arg_min(stop, i) as open, max(stop) as last
    from c_islands group by path, island
    having arg_max(mark, i) = '}' and arg_max(depth, i) = 0 and arg_min(mark, i) = '{'"""
CTES["c_heads"] = r"""
    select b.path, c.content, last,
        substring(code, cast(start + 1 as bigint), cast(open - start - 1 as bigint)) as raw_head,
        start + length(regexp_extract(substring(code, cast(start + 1 as bigint), cast(open - start - 1 as bigint)), '^\s*')) as begins
    from c_blocks b join c_code c on b.path = c.path"""
CTES["c_bodies"] = rf"""
    select path, regexp_extract(raw_head, '{_HEAD}', 1) as name,
        regexp_extract(raw_head, '{_HEAD}', 2) as params,
        regexp_extract(raw_head, '{_HEAD}', 0) as declarator,
        ltrim(raw_head, chr(10) || chr(9) || ' ') as head,
        substring(content, cast(begins + 1 as bigint), cast(last - begins as bigint)) as body,
        1 + begins - length(replace(substring(content, 1, cast(begins as bigint)), chr(10), '')) as start_line
    from c_heads"""
_QUALIFIERS = "|".join(QUALIFIER_WORDS)
_STORAGE = "|".join(STORAGE_WORDS)
CTES["c_functions"] = rf"""
    select path as file_path, name, body, cast(start_line as bigint) as start_line,
        cast(start_line + length(body) - length(replace(body, chr(10), '')) as bigint) as end_line,
        trim(regexp_replace(declarator, '\s+', ' ', 'g')) as signature,
        array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(params,
            '\(\s*\*+\s*(\w+)\s*\)\s*\([^()]*\)', ' *\1', 'g'), '\[[^\]]*\]', '', 'g'),
            '\b(?:{_QUALIFIERS})\b', ' ', 'g'), ','),
            lambda p: regexp_extract(p, '^\s*(?:(?:struct|union|enum)\s+)?\w+(?:[\s*]+\w+)*?[\s*]+(\w+)\s*$', 1)),
            lambda n: n not in {_in(("", *TYPE_WORDS))}), ',') as params,
        trim(regexp_replace(regexp_replace(left(head, length(head) - length(declarator)),
            '\b(?:{_STORAGE})\b', ' ', 'g'), '\s+', ' ', 'g')) as return_type,
        row_number() over (partition by path order by start_line) as position
    from c_bodies where name not in {_in(("", *CONTROL_WORDS))}"""
CTES["c_parsed"] = f"""
    select s.path, {LINES.format('s.content')} as line_count,
        case when {LANGUAGE.format('s.path')} = 'cpp' then 'C++ parsing is not supported'
             when o.open_depth <> 0 then 'unbalanced braces' else '' end as error,
        coalesce(n.functions, 0) as functions
    from c_sources s left join c_open o on s.path = o.path
    left join (select file_path, count(*) as functions from c_functions group by 1) n on s.path = n.file_path"""

# --- chunks, replies, results ---------------------------------------------------------------------
CTES["c_all_chunks"] = f"""
    select sha256(body) as chunk_id, name as chunk_name, file_path, start_line, end_line,
        end_line - start_line + 1 as line_count, position, body as code, {TOKENS.format('body')} as tokens
    from c_functions"""
CTES["c_chunks"] = f"select * from c_all_chunks where tokens <= {q.MAX_TOKENS}"
CTES["c_latest"] = """
    select chunk_id, arg_max(raw, version) as raw, arg_max(tokens, version) as tokens from c_responses group by 1"""
CTES["c_joined"] = """
    select c.*, coalesce(r.raw, '') as raw_response, coalesce(r.tokens, 0) as tokens_used,
        r.chunk_id is not null as replied
    from c_chunks c left join c_latest r on c.chunk_id = r.chunk_id"""


def _checked(rows: str, raw: str) -> str:
    """Rows with the JSON of their reply, failing fields and message."""
    found = rf"regexp_extract({raw}, '(?s)\{{.*\}}')"
    json = f"case when ltrim({raw})[1:1] <> '[' and json_valid({found}) then {found} end"
    checks = [f"case when coalesce(json_type(j, '$.{o}'), '') <> 'OBJECT' then '{o}' end" for o in OBJECT_FIELDS]
    for f in FIELDS:
        at, kind = f"'$.{f.path}'", f"json_type(j, '$.{f.path}')"
        if f.kind == "list":
            ok = f"{kind} is null or ({kind} = 'ARRAY' and len(list_filter(json_type(j, '$.{f.path}[*]'), lambda x: x <> 'VARCHAR')) = 0)"
        else:
            ok = f"coalesce({kind}, '') = 'VARCHAR'" if f.required else f"{kind} is null or {kind} = 'VARCHAR'"
            if f.nonempty:
                ok += f" and length(json_extract_string(j, {at})) >= 1"
        parent = f"json_type(j, '$.{f.parent}') = 'OBJECT' and " if f.parent else ""
        checks.append(f"case when {parent}not ({ok}) then '{f.path}' end")
    listed = "list_filter([" + ", ".join(checks) + "], lambda e: e is not null)"
    return f"""
    select *, case when j is null then 'json' else array_to_string({listed}, ',') end as errors,
        case when j is null and ltrim({raw})[1:1] = '[' then 'JSON is not an object'
             when j is null and position('{{' in {raw}) = 0 then 'No JSON object found in response'
             when j is null then 'No valid JSON found in response'
             when len({listed}) > 0 then concat('validation failed: ', array_to_string({listed}, ', ')) end as error
    from (select *, {json} as j from {rows})"""


_FAIL = FailureText()


NO_REPLY = "case when replied then error else 'no reply' end"


def _value(path: str, failed: str) -> str:
    return f"case when error is not null then {failed} else coalesce(json_extract_string(j, '$.{path}'), '') end"


def _list(path: str, marker: str) -> str:
    items = f"coalesce(json_extract_string(j, '$.{path}[*]'), cast([] as varchar[]))"
    return f"case when error is not null then ['{marker}'] else {items} end"


CTES["c_checked"] = f"select * replace ({NO_REPLY} as error) from ({_checked('c_joined', 'raw_response')})"
_MARK = f"'{_FAIL.marker}'"
CTES["c_results"] = f"""
    select chunk_id, chunk_name, file_path, start_line, line_count, position, tokens, tokens_used, raw_response,
        case when not replied then 'missing' when error is not null then 'invalid' else 'ok' end as status, error,
        {_value('function_role', f"concat({_MARK}, left(error, 100))")} as function_role,
        {_value('behavior.normal_case', _MARK)} as normal_case,
        {_list('behavior.special_cases', _FAIL.item)} as special_cases,
        {_list('behavior.error_cases', _FAIL.item)} as error_cases,
        {_value('data_flow.inputs', _MARK)} as inputs,
        {_value('data_flow.outputs', _MARK)} as outputs,
        {_value('data_flow.side_effects', _MARK)} as side_effects,
        {_list('call_graph.calls', _FAIL.callee)} as calls,
        {_list('call_graph.called_by', _FAIL.callee)} as called_by,
        {_value('state_management', _MARK)} as state_management,
        {_value('assumptions', f"'{_FAIL.assumption}'")} as assumptions,
        {_value('notes', f"concat('{_FAIL.note}', error)")} as notes
    from c_checked"""
CTES["c_found"] = "select * from c_results where status <> 'missing'"
CTES["c_outcome"] = """
    select p.path, case when coalesce(r.ok, 0) > 0 then 'successful' else 'failed' end as outcome,
        case when coalesce(r.ok, 0) > 0 then '' when p.error <> '' then p.error
             when p.functions = 0 then 'no functions' when r.n is null then 'no chunks'
             else 'all chunks failed' end as reason,
        coalesce(r.n, 0) as chunks, coalesce(r.ok, 0) as successful_chunks,
        coalesce(r.n - r.ok, 0) as failed_chunks, coalesce(r.invalid, 0) as invalid_chunks,
        cast(coalesce(r.tokens, 0) as bigint) as total_tokens
    from c_parsed p left join (
        select file_path, count(*) as n, count(*) filter (where status <> 'missing') as ok,
            count(*) filter (where status = 'invalid') as invalid,
            sum(case when status <> 'missing' then tokens_used else 0 end) as tokens
        from c_results group by 1) r on p.path = r.file_path"""
CTES["c_stats"] = """
    select count(*) as total_files, count(*) filter (where outcome = 'successful') as successful_files,
        count(*) filter (where outcome = 'failed') as failed_files, cast(sum(chunks) as bigint) as total_chunks,
        cast(sum(successful_chunks) as bigint) as successful_chunks,
        cast(sum(failed_chunks) as bigint) as failed_chunks,
        cast(sum(invalid_chunks) as bigint) as invalid_chunks,
        cast(sum(total_tokens) as bigint) as total_tokens
    from c_outcome"""
CTES["c_errors"] = f"""
    select case when error = 'unbalanced braces' then 'parse' else 'unexpected' end as kind,
        path as file_path, cast(0 as bigint) as start_line,
        concat({NAME.format('path')}, case when error = 'unbalanced braces' then ': Parse error - '
            else ': Unexpected error - ' end, error) as message
    from c_parsed where error <> ''
    union all
    select 'chunk', file_path, start_line, concat({NAME.format('file_path')}, ':', chunk_name, ' - no reply')
    from c_results where status = 'missing'"""
CTES["c_edges"] = """
    select distinct caller, callee from (
        select chunk_name as caller, unnest(calls) as callee from c_results where status = 'ok'
        union all
        select unnest(called_by), chunk_name from c_results where status = 'ok')"""

# --- scans, scalars ---------------------------------------------------------------------------------
_BROKEN = "lang = 'es'"
oracle(
    "decode_text",
    f"""select path, case when {_BROKEN} then 'latin-1' else 'utf-8' end as encoding,
        case when {_BROKEN} then strlen(content) + 2 else length(content) end as n_chars,
        case when not {_BROKEN} then sha256(content) end as hash from c_files""",
)
oracle(
    "load_quarantine",
    f"""select case when {_BROKEN} then 'quarantined' else 'loaded' end as status,
        case when {_BROKEN} then 'not utf-8' else '' end as reason, count(*) as n from c_files group by 1, 2""",
)
oracle("content_hash", "select path, sha256(content) as hash from c_files")
oracle(
    "detect_language",
    f"""select path, {NAME.format('path')} as name, substring(path, 6) as relative_path,
        {SUFFIX.format('path')} as suffix, {LANGUAGE.format('path')} as language from c_files""",
)
oracle("line_count", f"select path, {LINES.format('content')} as lines from c_files")
oracle("token_estimate", f"select path, {TOKENS.format('content')} as tokens from c_files")
oracle(
    "strip_comments",
    f"""select page_id, length(x) as n, md5(x) as digest
        from (select page_id, {STRIPPED.format('html')} as x from pages)""",
)
oracle("strip_source_comments", f"select path, md5({STRIPPED.format('content')}) as digest from c_sources")
oracle(
    "normalize_whitespace",
    rf"""select path, md5(regexp_replace(regexp_replace({NO_COMMENTS.format('content')}, '[ \t]+', ' ', 'g'),
        '\n\s*\n', chr(10), 'g')) as digest from c_files""",
)
_P = PromptText()
oracle(
    "render_prompts",
    f"""select conv_id, turn, md5(concat({_text(_P.head)}, text, {_text(_P.middle)},
        case when turn > 0 then role else '{_P.no_context}' end, {_text(_P.tail)})) as digest from conversations""",
)
oracle("embedding_text", "select file_path, start_line, md5(concat(name, chr(10), body)) as digest from c_functions")

# --- extraction, chunks ------------------------------------------------------------------------------
oracle(
    "extract_functions",
    """select file_path, name, start_line, end_line, end_line - start_line + 1 as line_count,
        md5(body) as digest from c_functions""",
)
oracle("function_signature", "select file_path, start_line, signature, params, return_type from c_functions")
oracle(
    "parse_status",
    """select path, case when error <> '' and functions > 0 then 'partial' when error <> '' then 'error' when functions = 0 then 'no functions' else 'parsed' end
        as status, error, functions from c_parsed""",
)


def _directives(pattern: str, column: str) -> str:
    return f"""select path, unnest(found) as {column}, generate_subscripts(found, 1) as position
        from (select path, regexp_extract_all(content, '{pattern}', 1) as found from c_sources)"""


oracle("extract_includes", _directives(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', "include"))
oracle("extract_macros", _directives(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)", "macro"))
oracle(
    "make_chunks",
    f"""select sha256(body) as id, 'function' as type, name, {TOKENS.format('body')} as tokens, file_path,
        {NAME.format('file_path')} as file_name, start_line, end_line, end_line - start_line + 1 as line_count,
        params, return_type from c_functions""",
)
_WITHOUT = _in(C_SUFFIXES + CPP_SUFFIXES)
_WITH = _in(C_SUFFIXES + CPP_SUFFIXES + HEADER_SUFFIXES)
oracle(
    "filter_extensions",
    f"""select path, 'with headers' as mode from c_files where {SUFFIX.format('path')} in {_WITH} union all
        select path, 'without headers' from c_files where {SUFFIX.format('path')} in {_WITHOUT}""",
)
oracle(
    "budget_filter",
    f"""select case when tokens > {q.MAX_TOKENS} then 'oversize' when tokens < 100 then 'small' else 'kept' end
        as budget, count(*) as n, cast(sum(tokens) as bigint) as tokens from c_all_chunks group by 1""",
)


def _packed(rows: str, key: str, text: str, budget: int) -> str:
    """Greedy packing as a recursive walk over the lines of all texts at once."""
    return f"""
    with recursive {key}_lines as (
        select {key}, i, line, {TOKENS.format('line')} as tokens
        from (select {key}, unnest(ls) as line, generate_subscripts(ls, 1) as i
              from (select {key}, string_split({text}, chr(10)) as ls from {rows}))),
    walk as (
        select {key}, i, 1 as block, tokens as total from {key}_lines where i = 1
        union all
        select l.{key}, l.i, case when w.total + l.tokens > {budget} then w.block + 1 else w.block end,
            case when w.total + l.tokens > {budget} then l.tokens else w.total + l.tokens end
        from walk w join {key}_lines l on l.{key} = w.{key} and l.i = w.i + 1)
    select w.{key}, cast(w.block as bigint) as block, string_agg(l.line, chr(10) order by w.i) as code
    from walk w join {key}_lines l on l.{key} = w.{key} and l.i = w.i group by 1, 2"""


CTES["c_file_blocks"] = _packed("c_files", "path", "content", q.BLOCK_TOKENS)
oracle(
    "block_split",
    f"select path, block, {TOKENS.format('code')} as tokens, md5(code) as digest from c_file_blocks",
)
CTES["c_near_blocks"] = """
    select path, block, concat_ws(chr(10),
        lag(last) over (partition by path order by block), code, lead(first) over (partition by path order by block)) as code
    from (select path, block, code, array_to_string(ls[greatest(len(ls) - 9, 1):], chr(10)) as last,
            array_to_string(ls[1:10], chr(10)) as first
        from (select path, block, code, string_split(code, chr(10)) as ls from c_file_blocks))"""
oracle("part_overlap", f"select path, block, {TOKENS.format('code')} as tokens, md5(code) as digest from c_near_blocks")
CTES["c_large"] = f"select file_path, name, code from (select file_path, chunk_name as name, code, tokens from c_all_chunks) where tokens > {q.MAX_TOKENS}"
CTES["c_large_keyed"] = "select concat(file_path, '|', name) as id, code from c_large"
CTES["c_large_blocks"] = _packed("c_large_keyed", "id", "code", q.MAX_TOKENS)
oracle(
    "hybrid_split",
    f"""select file_path, 'function' as type, chunk_name as name, '' as parent, tokens, md5(code) as digest
        from c_all_chunks where tokens <= {q.MAX_TOKENS} union all
        select string_split(id, '|')[1], 'function_part', concat(string_split(id, '|')[2], '_part', block),
            string_split(id, '|')[2], {TOKENS.format('code')}, md5(code) from c_large_blocks""",
)
CTES["c_overlapped"] = """
    select file_path, name, concat_ws(chr(10),
        array_to_string(list_slice(string_split(lag(body) over w, chr(10)), -2, -1), chr(10)), body,
        array_to_string(list_slice(string_split(lead(body) over w, chr(10)), 1, 2), chr(10))) as code
    from c_functions window w as (partition by file_path order by start_line)"""
oracle(
    "overlap_window",
    f"select file_path, name, {TOKENS.format('code')} as tokens, md5(code) as digest from c_overlapped",
)
CTES["c_context"] = r"""
    select path, left(array_to_string(list_concat(
        list_transform(regexp_extract_all(content, '(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', 1),
            lambda n: concat('#include ', n)),
        list_transform(regexp_extract_all(content, '(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)', 1),
            lambda n: concat('#define ', n))), chr(10)), 5000) as context from c_sources"""
oracle(
    "chunk_context",
    """select sha256(f.body) as id, f.file_path, md5(c.context) as digest, false as truncated
        from c_functions f join c_context c on f.file_path = c.path""",
)
oracle(
    "run_prompts",
    f"""select chunk_id, file_path, md5(concat({_text(_P.head)}, code, {_text(_P.middle)},
            case when context = '' then '{_P.no_context}' else context end, {_text(_P.tail)})) as digest, false as truncated
        from (select c.chunk_id, c.file_path, c.code, x.context,
            row_number() over (partition by c.chunk_id order by c.file_path, c.start_line) as n
            from c_chunks c join c_context x on c.file_path = x.path) where n = 1""",
)
oracle(
    "files_without_functions",
    """select path, case when error <> '' then 'error' else 'no functions' end as status
        from c_parsed where functions = 0""",
)
oracle("files_without_result", "select path from c_sources where path not in (select file_path from c_found)")

# --- replies -----------------------------------------------------------------------------------------
oracle(
    "join_responses",
    "select file_path, chunk_name, md5(raw_response) as digest, tokens_used, replied from c_joined",
)
oracle(
    "prompt_replies",
    """select concat(u.conv_id, ':', u.turn) as chunk_id, md5(coalesce(a.text, '')) as digest,
        coalesce(length(a.text), 0) as tokens_used, a.text is not null as replied
        from conversations u left join conversations a
            on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
        where u.role = 'user'""",
)
_MODELS = "[" + ", ".join(f"'{m}'" for m in q.MODELS) + "]"
oracle(
    "assign_models",
    f"""select file_path, name, position, {_MODELS}[(position - 1) % {len(q.MODELS)} + 1] as model
        from (select file_path, name, row_number() over (order by file_path, start_line) as position
              from c_functions)""",
)
CTES["c_checked_replies"] = _checked("c_responses", "raw")
oracle(
    "extract_json",
    """select chunk_id, version, j is not null as found, json_extract_string(j, '$.function_role') as role
        from c_checked_replies""",
)
oracle(
    "validate_responses",
    """select chunk_id, version, error is null as valid, errors,
        case when error is null then json_extract_string(j, '$.function_role') end as role,
        case when error is null then array_to_string(json_extract_string(j, '$.call_graph.calls[*]'), ',') end as calls,
        case when error is null then coalesce(json_extract_string(j, '$.notes'), '') end as notes
        from c_checked_replies""",
)
oracle(
    "assemble_results",
    """select file_path, chunk_name, status, function_role, normal_case,
        array_to_string(special_cases, ',') as special_cases, array_to_string(calls, ',') as calls, notes,
        tokens_used from c_results""",
)
oracle(
    "functions_table",
    """select file_path as file, chunk_name as function, function_role as role, cast(len(calls) as integer) as calls,
        cast(len(called_by) as integer) as callers, cast(len(special_cases) as integer) as special_cases,
        cast(len(error_cases) as integer) as error_cases, tokens_used as tokens from c_found""",
)
oracle(
    "results_json",
    """select file_path, start_line, status, function_role as role,
        calls[2] as second_call from c_results""",
)
_SUMMARY = """
    select chunk_id, count(*) filter (where outcome = 'transient') as failures, bool_or(outcome = 'success') as succeeded,
        cast(floor(epoch(max(ts))) as bigint) - cast(floor(epoch(min(ts))) as bigint) as elapsed_seconds
    from c_attempts group by 1"""
CTES["c_tries"] = f"""
    select *, not succeeded and failures > 0 and (failures >= 3 or elapsed_seconds >= 3600) as gave_up
    from ({_SUMMARY})"""
oracle(
    "attempt_summary",
    """select chunk_id, failures, failures - case when gave_up then 1 else 0 end as retries, elapsed_seconds,
        succeeded, gave_up from c_tries""",
)
oracle(
    "retry_queue",
    """select chunk_id, failures, elapsed_seconds,
        least(pow(2, failures - 1), cast(3600 - elapsed_seconds as double)) as next_wait_seconds
        from c_tries where not succeeded and not gave_up and failures > 0""",
)

# --- snapshots and caches ------------------------------------------------------------------------------
CTES["c_new"] = "select path, sha256(content) as hash from c_files"
CTES["c_old"] = f"""
    select path, sha256(case when toxic = 1 then concat(content, chr(10), '// old') else content end) as hash,
        timestamp '{q.AS_OF}' - to_days(cast(f.doc_id % 60 as integer)) as ts
    from c_files f join labels l on f.doc_id = l.doc_id
    union all
    select concat('bench/i', item_id, '.c'), sha256(text),
        timestamp '{q.AS_OF}' - to_days(cast(item_id % 60 as integer)) from benchmark"""
oracle(
    "snapshot_diff",
    """select coalesce(o.path, n.path) as path, o.hash as old_hash, n.hash as new_hash,
        case when o.hash is null then 'added' when n.hash is null then 'removed'
             when o.hash <> n.hash then 'changed' else 'same' end as change
        from c_old o full outer join c_new n on o.path = n.path""",
)
oracle("cache_split", "select path, hash in (select hash from c_old) as cached from c_new")
oracle(
    "cache_latest",
    """select hash, path, strftime(ts, '%Y-%m-%d') as day from (
        select *, row_number() over (partition by hash order by ts desc, path desc) as n from c_old) where n = 1""",
)
oracle(
    "cache_ttl",
    f"""select path, strftime(ts, '%Y-%m-%d') as day from c_old
        where ts >= timestamp '{q.AS_OF}' - interval 30 days""",
)
oracle(
    "delete_by_file",
    f"""select chunk_id, file_path, chunk_name from c_all_chunks where file_path not in (
        select {t.SOURCE_PATH} from part where p_type = 'SMALL')""",
)
CTES["c_defined"] = """
    select name, count(*) as definitions, min(file_path) as callee_file,
        arg_min(start_line, concat(file_path, ' ', lpad(cast(start_line as varchar), 9, '0'))) as callee_line
    from c_functions group by 1"""
oracle(
    "resolve_calls",
    """select e.caller, e.callee, coalesce(d.definitions, 0) as definitions, d.callee_file, d.callee_line,
        d.name is not null as resolved, e.caller in (select name from c_defined) as caller_known
        from c_edges e left join c_defined d on e.callee = d.name""",
)
oracle("call_edges", "select caller, callee from c_edges")
CTES["c_called"] = """
    with recursive walk(name, steps) as (
        select 'main', cast(0 as bigint)
        union
        select e.callee, w.steps + 1 from walk w join c_edges e on e.caller = w.name
        where e.caller <> e.callee and w.steps < 20)
    select name, min(steps) as steps from walk group by 1"""
oracle("call_reach", "select name, steps from c_called")
# Both kinds of steps ascend, so the walk ends by itself.
CTES["c_stepped"] = """
    with recursive walk(name, steps) as (
        select p_partkey, cast(0 as bigint) from part where p_partkey between 1 and 10
        union
        select e.callee, w.steps + 1 from walk w join (
            select p_partkey as caller, p_partkey + 1 as callee from part where p_size % 7 <> 0
            union select p_partkey, p_partkey * 2 from part where p_size % 3 = 0) e on e.caller = w.name
        where w.steps < 400)
    select name, min(steps) as steps from walk group by 1"""
oracle("dependency_steps", "select name, steps from c_stepped")

# --- reports --------------------------------------------------------------------------------------------
_TOTALS = """count(*) as total_chunks, cast(coalesce(sum(tokens), 0) as bigint) as total_tokens,
    cast(coalesce(sum(tokens) // nullif(count(*), 0), 0) as bigint) as avg_tokens,
    coalesce(min(tokens), 0) as min_tokens, coalesce(max(tokens), 0) as max_tokens"""
oracle("chunk_stats", f"select {_TOTALS} from c_all_chunks")
_RATE = "case when total_chunks = 0 then 0.0 else failed_chunks / cast(total_chunks as double) end"
oracle(
    "run_stats",
    f"select *, round({_RATE}, 6) as error_rate, round(1.0 - ({_RATE}), 6) as success_rate from c_stats",
)
ORACLES["run_incremental"] = ORACLES["run_stats"]
oracle("file_outcome", "select * from c_outcome")
oracle(
    "quality_gate",
    f"""select total_chunks, failed_chunks, round({_RATE}, 6) as error_rate,
        case when {_RATE} > 0.05 or total_chunks = 0 then 'fail' else 'pass' end as verdict,
        case when {_RATE} > 0.05 then 'error rate exceeds limit' when total_chunks = 0 then 'no chunks analyzed'
             else '' end as reason from c_stats""",
)
CTES["c_project"] = """
    select count(distinct file_path) as total_files, count(*) as total_functions,
        cast(coalesce(sum(line_count), 0) as bigint) as total_lines,
        cast(coalesce(sum(tokens_used), 0) as bigint) as total_tokens from c_found"""
oracle(
    "project_summary",
    """select total_files, total_functions, total_lines, total_tokens as approx_lines, total_tokens,
        'N/A' as avg_complexity from c_project""",
)
oracle(
    "metrics_long",
    """select 'project' as category, 'total_files' as metric, total_files as value from c_project
    union all select 'project', 'total_functions', total_functions from c_project
    union all select 'project', 'total_lines', total_tokens from c_project
    union all select 'quality', 'error_cases', cast(sum(len(error_cases)) as bigint) from c_found
    union all select 'quality', 'special_cases', cast(sum(len(special_cases)) as bigint) from c_found
    union all select 'tokens', 'total_tokens', total_tokens from c_project""",
)
CTES["c_summary"] = f"""
    select r.file_path, {NAME.format('r.file_path')} as name, r.n as function_count, r.tokens as approx_lines,
        cast(p.line_count as bigint) as total_lines, r.tokens as total_tokens
    from (select file_path, count(*) as n, cast(sum(tokens_used) as bigint) as tokens from c_found group by 1) r
    join c_parsed p on r.file_path = p.path"""
oracle("file_summary", "select * from c_summary")
oracle(
    "file_rollup",
    """select file_path, count(*) as function_count, cast(sum(tokens_used) as bigint) as total_tokens,
        cast(grouping(file_path) as integer) as is_total from c_found group by rollup(file_path)""",
)

_W = DocumentText()


def _bullets(heading: str, items: str, quote: str = "") -> str:
    lines = f"list_transform({items}, lambda x: concat('- {quote}', x, '{quote}', chr(10)))"
    return f"case when len({items}) > 0 then concat('{heading}', chr(10), array_to_string({lines}, ''), chr(10)) else '' end"


def _paragraph(heading: str, column: str) -> str:
    return f"case when {column} <> '' then concat('#### {heading}', chr(10), {column}, chr(10), chr(10)) else '' end"


_SECTION = f"""concat('### `', chunk_name, {_text(f"`{chr(10)}{chr(10)}#### {_W.role}{chr(10)}")}, function_role,
    {_text(f"{chr(10)}{chr(10)}#### {_W.behavior}{chr(10)}{chr(10)}**{_W.normal_case}**: ")}, normal_case, chr(10), chr(10),
    {_bullets(f"**{_W.special_cases}**:", "special_cases")}, {_bullets(f"**{_W.error_cases}**:", "error_cases")},
    {_text(f"#### {_W.data_flow}{chr(10)}{chr(10)}**{_W.inputs}**: ")}, inputs,
    {_text(f"{chr(10)}{chr(10)}**{_W.outputs}**: ")}, outputs,
    {_text(f"{chr(10)}{chr(10)}**{_W.side_effects}**: ")}, side_effects, chr(10), chr(10),
    {_bullets(f"#### {_W.calls}", "calls", "`")}, {_bullets(f"#### {_W.called_by}", "called_by", "`")},
    {_paragraph(_W.state_management, "state_management")}, {_paragraph(_W.assumptions, "assumptions")},
    {_paragraph(_W.notes, "notes")}, '---', chr(10), chr(10))"""


def _doc_header(path: str, count: str) -> str:
    return f"""concat('# ', {NAME.format(path)}, chr(10), chr(10), '**{_W.path}**: `', {path}, '`', chr(10),
        '**{_W.language}**: ', {LANGUAGE.format(path)}, chr(10), {count}
        chr(10), '---', chr(10), chr(10), '## {_W.functions}', chr(10), chr(10))"""


_COUNTED = f"'**{_W.function_count}**: ', count(*) over (partition by file_path), chr(10),"
CTES["c_doc_blocks"] = f"""
    select file_path, position as block, {_SECTION} as text from c_found
    union all select distinct file_path, 0, {_doc_header('file_path', _COUNTED)} from c_found
    union all select file_path, max(position) + 1, {_text(f"{chr(10)}{_W.footer}{chr(10)}")} from c_found group by 1"""
oracle("file_document", "select file_path, block, md5(text) as digest from c_doc_blocks")
CTES["c_doc_rows"] = f"""
    select file_path, 1 as part, cast(position as integer) as position, {_SECTION} as text from c_found
    union all select distinct file_path, 0, 0, {_doc_header('file_path', '')} from c_found
    union all select distinct file_path, 2, 0, {_text(f"{chr(10)}---{chr(10)}{chr(10)}{_W.footer}{chr(10)}")} from c_found"""
oracle(
    "document_rows",
    "select file_path, part, position, length(text) as n, md5(text) as digest from c_doc_rows",
)
oracle(
    "project_document",
    f"""select 0 as part, '' as file_path, concat({_text(f"# parts {_W.title}{chr(10)}{chr(10)}## {_W.overview}{chr(10)}{chr(10)}- total_files: ")},
        total_files, {_text(f"{chr(10)}- total_functions: ")}, total_functions,
        {_text(f"{chr(10)}- total_lines: ")}, total_lines, {_text(f"{chr(10)}- avg_complexity: N/A{chr(10)}- total_tokens: ")},
        total_tokens, {_text(f"{chr(10)}{chr(10)}## {_W.files}{chr(10)}{chr(10)}| name | functions | lines | path |{chr(10)}|---|---|---|---|{chr(10)}")}) as text
        from c_project
    union all select 1, file_path, concat('| [', name, '](files/', file_path, '.md) | ', function_count, ' | ',
        total_lines, ' | `', file_path, '` |', chr(10)) from c_summary
    union all select 2, '', {_text(f"{chr(10)}{_W.no_issues}{chr(10)}{chr(10)}---{chr(10)}{chr(10)}{_W.footer}{chr(10)}")}""",
)
oracle(
    "token_totals",
    """select cast(coalesce(sum(case when status = 'ok' then tokens_used end), 0) as bigint) as analyzer_tokens,
        cast(coalesce(sum(case when status <> 'missing' then tokens_used end), 0) as bigint) as run_tokens
        from c_results""",
)
oracle(
    "token_cost",
    """select input_tokens, output_tokens,
        round(input_tokens / 1000 * cast(0.01 as double) + output_tokens / 1000 * cast(0.03 as double), 4) as cost
        from (select cast(sum(tokens) as bigint) as input_tokens, cast(sum(tokens_used) as bigint) as output_tokens
              from c_joined)""",
)
oracle(
    "run_metrics",
    """select round(avg(value), 6) as avg_latency_ms, cast(sum(user_id) as bigint) as total_tokens,
        round(count(*) filter (where outcome = 'success') / cast(count(*) as double), 6) as cache_hit_rate,
        round(count(*) filter (where outcome = 'transient') / cast(count(*) as double), 6) as error_rate from c_attempts""",
)
oracle(
    "coverage",
    """select a.n as analyzed_lines, f.n as total_lines,
        round(case when f.n = 0 then 0.0 else a.n / cast(f.n as double) end, 6) as coverage
        from (select cast(coalesce(sum(line_count), 0) as bigint) as n from c_results where status = 'ok') a,
             (select cast(sum(line_count) as bigint) as n from c_parsed) f""",
)
oracle(
    "distinct_token_counts",
    f"select sha256(content) as hash, {TOKENS.format('any_value(content)')} as tokens, count(*) as occurrences from c_files group by 1",
)

# --- windows, sets -----------------------------------------------------------------------------------------
oracle(
    "chunk_positions",
    """select file_path, name, position as in_file, count(*) over (partition by file_path) as function_count,
        row_number() over (order by file_path, start_line) as position from c_functions""",
)
oracle("error_log", "select kind, file_path, start_line, message from c_errors")
oracle(
    "first_errors",
    """select message from (select message from c_errors order by file_path, start_line, message limit 10)
    union all select concat('... and ', n - 10, ' more') from (select count(*) as n from c_errors) where n > 10""",
)
oracle(
    "dedup_chunks",
    """select chunk_id as id, chunk_name as name, file_path, start_line, tokens, copies from (
        select *, count(*) over (partition by chunk_id) as copies,
            row_number() over (partition by chunk_id order by file_path, start_line) as n from c_all_chunks)
        where n = 1""",
)
oracle(
    "rate_slots",
    """select event_id, user_id as tokens, row_number() over (order by event_id) as position,
        true as within_limits, user_id > 10000 as over_limit from events""",
)
oracle(
    "oversize",
    f"select file_path, chunk_name, start_line, tokens from c_all_chunks where tokens > {q.MAX_TOKENS}",
)
# The brand decides what no one closes; the line follows from the texts before it.
oracle(
    "parse_rejects",
    f"""select path, cast(len(string_split(content, chr(10))) - 1 as bigint) as start_line, 'never closed' as reason
        from c_sources s join part p on s.path = {t.SOURCE_PATH}
        where p_brand = 'Brand#25' and {LANGUAGE.format('path')} = 'c'""",
)

# --- vectors -------------------------------------------------------------------------------------------------


def _nearest(where: str = "true", most: int = 5) -> str:
    distance = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]) * (p[1]::double - p[2])))"
    return f"""
    select query_id, rank, vec_id, distance, label, wanted from (
        select *, row_number() over (partition by query_id order by distance, vec_id) as rank from (
            select q.vec_id as query_id, e.vec_id, e.label, q.label as wanted, {distance} as distance
            from embeddings e, embeddings q where q.vec_id % 20 = 0 and {where})) where rank <= {most}"""


CTES["c_nearest"] = _nearest()
CTES["c_nearest_filtered"] = _nearest("e.label >= 5")
CTES["c_nearest_others"] = _nearest("e.vec_id <> q.vec_id")
oracle("vector_topk", "select query_id, rank, vec_id, round(distance, 6) as distance from c_nearest")
oracle(
    "vector_topk_filtered", "select query_id, rank, vec_id, round(distance, 6) as distance from c_nearest_filtered"
)
oracle("vector_recall", "select count(*) as wanted, true as enough from c_nearest")
CTES["c_center"] = """
    select list(m order by dim) as point from (
        select dim, avg(x) as m from (
            select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings)
        group by 1)"""
oracle(
    "vector_search",
    """select vec_id, round(distance, 6) as distance from (
        select vec_id, list_sum(list_transform(list_zip(embedding, point),
            lambda p: (p[1]::double - p[2]) * (p[1]::double - p[2]))) as distance from embeddings, c_center)
        order by distance, vec_id limit 5""",
)
oracle(
    "retrieval_accuracy",
    """select count(*) as queries, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / cast(count(*) as double), 6) as accuracy
        from (select query_id, bool_or(label = wanted) as hit from c_nearest_others group by 1)""",
)
oracle(
    "vector_upsert",
    """select vec_id, case when label < 5 then label + 100 else label end as label, len(embedding) as dims,
            cast(embedding[case when label < 5 then 64 else 1 end] as double) as first,
            cast(embedding[case when label < 5 then 1 else 64 end] as double) as last from embeddings
        union all select vec_id + 1000000, label + 100, len(embedding), cast(embedding[64] as double),
            cast(embedding[1] as double) from embeddings where label >= 5""",
)

ORACLES["stored_upsert"] = ORACLES["vector_upsert"]
ORACLES["stored_delete"] = ORACLES["delete_by_file"]

# --- streams ---------------------------------------------------------------------------------------------------
CTES["c_stream"] = f"""
    select {t.SOURCE_PATH} as file_path, concat('f', p_partkey) as chunk_name, {t.F_REPLY} as raw_response,
        cast(p_size * 10 as bigint) as tokens_used from part where {t.REPLIED}"""
CTES["c_stream_checked"] = _checked("c_stream", "raw_response")
oracle(
    "stream_append",
    f"""select file_path, chunk_name, case when error is not null then 'invalid' else 'ok' end as status,
        {_value('function_role', f"concat({_MARK}, left(error, 100))")} as function_role, tokens_used
        from c_stream_checked""",
)
oracle("stream_append_csv", "select file_path, md5(raw_response) as digest from c_stream")
# Replies after more than five minutes come too late.
CTES["c_prompted"] = f"""
    select {t.SOURCE_PATH} as file_path, concat('f', p_partkey) as chunk_name, {t.F_REPLY} as raw_response,
        {t.REPLIED} and p_partkey % 10 <= 5 as replied from part"""
CTES["c_prompted_checked"] = _checked("c_prompted", "raw_response")
oracle(
    "stream_replies",
    f"""select file_path, chunk_name, case when not replied then 'missing' when error is not null then 'invalid' else 'ok' end as status,
        case when not replied then concat({_MARK}, 'no reply') else {_value('function_role', f"concat({_MARK}, left(error, 100))")} end as function_role
        from c_prompted_checked""",
)
oracle(
    "stream_retries",
    """select chunk_id, failures, succeeded, elapsed_seconds, not succeeded and failures > 0 as gave_up from c_tries""",
)
oracle("stream_dedup", "select distinct sha256(concat(event_type, props)) as hash from events")
oracle("stream_stats", "select event_type, count(*) as n, cast(sum(user_id) as bigint) as tokens from events group by 1")
