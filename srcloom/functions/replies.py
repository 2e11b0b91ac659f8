"""JSON repair and strict validation of model replies, as one Spark SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom.functions.fold import let

# The reply schema, in the order of its fields.
OBJECT_FIELDS = ("behavior", "data_flow", "call_graph")


@dataclass(frozen=True)
class Field:
    path: str
    kind: str  # 'string' or 'list'
    required: bool = True
    nonempty: bool = False

    @property
    def parent(self) -> str | None:
        return self.path.split(".")[0] if "." in self.path else None

    @property
    def column(self) -> str:
        return self.path.split(".")[-1]


FIELDS = (
    Field("function_role", "string", nonempty=True),
    Field("behavior.normal_case", "string", nonempty=True),
    Field("behavior.special_cases", "list", required=False),
    Field("behavior.error_cases", "list", required=False),
    Field("data_flow.inputs", "string"),
    Field("data_flow.outputs", "string"),
    Field("data_flow.side_effects", "string"),
    Field("call_graph.calls", "list", required=False),
    Field("call_graph.called_by", "list", required=False),
    Field("state_management", "string"),
    Field("assumptions", "string"),
    Field("notes", "string", required=False),
)


def _key(path: str) -> str:
    return path.replace(".", "_")


# First JSON value at or after the first opening brace; text after it is ignored.
_FIRST_OBJECT = "case when instr(t, '{') > 0 then try_parse_json(substr(t, instr(t, '{'))) end"
# JSON in the first fenced block marked json.
_FENCED = "try_parse_json(regexp_extract(t, r'(?s)```json(.*?)```', 1))"
# True if the whole text is one JSON value that is no object.
_OTHER_JSON = let(
    "w",
    "try_parse_json(concat('[', t, ']'))",
    "not startswith(trim(leading chr(9) || chr(10) || chr(13) || ' ' from t), '{') "
    "and try_variant_get(w, '$[0]', 'variant') is not null "
    "and try_variant_get(w, '$[1]', 'variant') is null "
    "and not startswith(schema_of_variant(try_variant_get(w, '$[0]', 'variant')), 'OBJECT')",
)
# The whole text counts first, so JSON that is a list or a scalar yields nothing even if an
# object is inside it; then the first object in the text; then a fenced block.
_JSON = f"case when not coalesce({_OTHER_JSON}, false) then coalesce({_FIRST_OBJECT}, {_FENCED}) end"
_JSON_ERROR = f"""case when j is not null then null
    when coalesce({_OTHER_JSON}, false) then 'JSON is not an object'
    when instr(t, '{{') = 0 then 'No JSON object found in response'
    else 'No valid JSON found in response' end"""


def _type(path: str) -> str:
    return f"schema_of_variant(try_variant_get(j, '$.{path}', 'variant'))"


def _found() -> str:
    """Struct of JSON type (``x_type``) and value (``x``) at the schema's paths."""
    parts = [f"'{o}_type', {_type(o)}" for o in OBJECT_FIELDS]
    for f in FIELDS:
        kind = "array<string>" if f.kind == "list" else "string"
        parts.append(f"'{_key(f.path)}_type', {_type(f.path)}")
        parts.append(f"'{_key(f.path)}', try_variant_get(j, '$.{f.path}', '{kind}')")
    return f"named_struct({', '.join(parts)})"


def _is_object(name: str) -> str:
    return f"coalesce(startswith(v.{name}_type, 'OBJECT'), false)"


def _is_valid(field: Field) -> str:
    kind, value = f"v.{_key(field.path)}_type", f"v.{_key(field.path)}"
    if field.kind == "string":
        ok = f"{kind} = 'STRING'" + (f" and char_length({value}) >= 1" if field.nonempty else "")
    else:
        # A list of nulls shows as ARRAY<VOID> like an empty one; nulls among strings do
        # not show in the type at all.
        ok = (
            f"({kind} = 'ARRAY<STRING>' and not exists({value}, x -> x is null)) "
            f"or ({kind} = 'ARRAY<VOID>' and size({value}) = 0)"
        )
    return f"coalesce({ok}, {'false' if field.required else 'true'})"


def _errors() -> str:
    """Names of the fields that break the schema, in schema order.

    A null is no string and no list; only an absent optional field takes its default.
    """
    checks = [f"case when not {_is_object(o)} then '{o}' end" for o in OBJECT_FIELDS]
    for f in FIELDS:
        reached = f"{_is_object(f.parent)} and " if f.parent else ""
        checks.append(f"case when {reached}not {_is_valid(f)} then '{f.path}' end")
    return f"case when j is null then array('json') else array_compact(array({', '.join(checks)})) end"


def _reply() -> str:
    groups: dict[str, list[Field]] = {}
    for f in FIELDS:
        groups.setdefault(f.parent or f.path, []).append(f)

    def value(f: Field) -> str:
        default = "cast(array() as array<string>)" if f.kind == "list" else "''"
        return f"v.{_key(f.path)}" if f.required else f"coalesce(v.{_key(f.path)}, {default})"

    parts = []
    for name, members in groups.items():
        if members[0].path == name:
            parts.append(f"'{name}', {value(members[0])}")
        else:
            inner = ", ".join(f"'{f.column}', {value(f)}" for f in members)
            parts.append(f"'{name}', named_struct({inner})")
    return f"named_struct({', '.join(parts)})"


def checked_reply(text: str) -> Column:
    """Struct of a reply text: ``json`` found, failing ``errors``, ``error`` message, ``reply``.

    ``reply`` is the typed nested reply, null unless valid. One expression with bound steps:
    as separate columns a filter on the outcome would be pushed below them and copy the
    parsing into every place that reads it. ``text`` is SQL.
    """
    invalid = "case when size(e) > 0 then concat('validation failed: ', array_join(e, ', ')) end"
    result = (
        f"named_struct('json', j, 'errors', e, 'error', coalesce({_JSON_ERROR}, {invalid}), "
        f"'reply', case when size(e) = 0 then {_reply()} end)"
    )
    return F.expr(let("t", text, let("j", _JSON, let("v", _found(), let("e", _errors(), result)))))


def nested(values: dict[str, Column]) -> list[Column]:
    """Columns of the nested reply schema from values by path."""
    groups: dict[str, list[Field]] = {}
    for field in FIELDS:
        groups.setdefault(field.parent or field.path, []).append(field)
    return [
        values[name].alias(name)
        if name == members[0].path
        else F.struct(*[values[f.path].alias(f.column) for f in members]).alias(name)
        for name, members in groups.items()
    ]
