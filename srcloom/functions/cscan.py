"""Scanner for one C text: functions and rejected blocks, for texts of any length in linear time.

Literals, comments and directives are blanked in place, so offsets stay those of the text. Braces are matched
once with a stack; a brace that nothing closes opens no scope, so the complete functions around it are
kept. The head before a top-level block is read by matching its parentheses, to any depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Words of the C language that head a block but name no function.
CONTROL_WORDS = ("if", "else", "for", "while", "do", "switch", "return", "sizeof")
# Words of a declaration that are no part of a return type.
STORAGE_WORDS = ("static", "extern", "inline", "register", "auto", "_Noreturn")
# Type words that can end an unnamed parameter.
TYPE_WORDS = (
    "void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "bool",
)
QUALIFIER_WORDS = ("const", "volatile", "restrict", "register", "static")
# Words whose parentheses are no parameter list.
ATTRIBUTE_WORDS = ("__attribute__", "__attribute", "__declspec", "__asm__", "__asm", "asm", "_Alignas", "__extension__")
TAG_WORDS = ("struct", "union", "enum")

_STRING = r'"(?:[^"\\\n]++|\\.)*+"'
_LINE_COMMENT = r"//[^\n]*+"
_DIRECTIVE = (
    rf"^(?:[ \t]++|/\*.*?\*/)*+#"
    rf'(?:{_STRING}|{_LINE_COMMENT}|/\*.*?(?:\*/|\Z)|\\\n|[^\n"/\\]++|[^\n])*+'
)
_BLANK = re.compile(
    rf"(?P<directive>{_DIRECTIVE})|{_STRING}|'(?:[^'\\\n]++|\\.)*+'|{_LINE_COMMENT}|/\*.*?\*/|/\*.*", re.DOTALL | re.MULTILINE
)
_CONDITION = re.compile(r"(?:[ \t]|/\*.*?\*/)*#[ \t]*(ifdef|ifndef|if|elif|else|endif)\b", re.DOTALL)
_NOT_LINE_END = re.compile(r"[^\n]+")
_MARK = re.compile(r"[{};]")
_NESTING = re.compile(r"[()\[\],]")
_PAREN = re.compile(r"[()]")
_NAME_BEFORE = re.compile(r"([A-Za-z_]\w*)\s*\Z")
_LINKAGE = re.compile(r'\bextern\s*"(?:[^"\\\n]|\\.)*"\s*\Z')
_IDENTIFIERS = re.compile(r"\s*[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*\s*\Z")
_ATTRIBUTE = re.compile(rf"\b(?:{'|'.join(ATTRIBUTE_WORDS)})\b\s*")
_STORAGE = re.compile(rf"\b(?:{'|'.join(STORAGE_WORDS)})\b")
_QUALIFIER = re.compile(rf"\b(?:{'|'.join(QUALIFIER_WORDS)})\b")
_TAG = re.compile(rf"\b(?:{'|'.join(TAG_WORDS)})\b")
_FIRST_WORD = re.compile(r"[A-Za-z_]\w*")
_FUNCTION_POINTER = re.compile(r"[^()]*\(\s*(?:\*\s*)+(?:\w+\s+)*?(\w+)")
_SUBSCRIPT = re.compile(r"\[[^\]]*\]")
_PARAMETER_WORD = re.compile(r"\w+|\*")
# What may stand between the parameters and the block: macros, and the rest of a nested declarator.
_TRAILING = re.compile(r"[\s\w)]*(?:\([^{};]*\)[\s\w]*)?")


def _spaces(text: str) -> str:
    return _NOT_LINE_END.sub(lambda m: " " * len(m[0]), text)


def blanked(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with literals, comments and directives as blanks, and its conditional directives."""
    conditions: list[tuple[str, int, int]] = []

    def blank(found: re.Match) -> str:
        own = found[0]
        if found.lastgroup and (kind := _CONDITION.match(own)):
            conditions.append((kind[1], found.start(), found.end()))
        return _spaces(own) if "\n" in own else " " * len(own)

    return _BLANK.sub(blank, text), conditions


def one_branch(code: str, conditions: list[tuple[str, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """Where the branches of a conditional do not balance their braces, only the first one counts.

    Inner conditionals are judged before outer ones, without their hidden branches. The others are blanked for the
    scan; the bodies of functions are cut from the text itself. Also, the hidden branches that lie in no other one:
    offset of the conditional, start and end.
    """
    # By open conditional its branches: start, end, and the depth that hidden branches inside add to the running one.
    open_: list[list[list[int]]] = []
    hidden: list[tuple[int, int, int]] = []
    change = _changes(code)
    for kind, start, end in conditions:
        if kind.startswith("if"):
            open_.append([[end, -1, 0]])
        elif open_:
            branches = open_[-1]
            branches[-1][1] = start
            if kind != "endif":
                branches.append([end, -1, 0])
                continue
            open_.pop()
            if len(branches) > 1 and any(change(a, b) != inner for a, b, inner in branches):
                hidden += [(a, b, branches[0][0]) for a, b, _ in branches[1:]]
                if open_:
                    open_[-1][-1][2] += sum(change(a, b) for a, b, _ in branches[1:])
            elif open_:
                open_[-1][-1][2] += sum(inner for _, _, inner in branches)
    if not hidden:
        return code, []
    parts, outer, at = [], [], 0
    for start, end, first in sorted(hidden):
        if start >= at:
            parts += [code[at:start], _spaces(code[start:end])]
            outer.append((first, start, end))
            at = end
    return "".join([*parts, code[at:]]), outer


def _changes(code: str):
    """By how much the braces between two offsets change the depth."""
    marks = [m.start() for m in re.finditer(r"[{}]", code)]
    depths = [0]
    for m in marks:
        depths.append(depths[-1] + (1 if code[m] == "{" else -1))

    def change(start: int, end: int) -> int:
        return depths[bisect_right(marks, end - 1)] - depths[bisect_right(marks, start - 1)]

    return change


def groups(head: str) -> list[tuple[int, int]]:
    """Offsets of the top-level parentheses of a head."""
    found, depth, start = [], 0, 0
    for m in _PAREN.finditer(head):
        if m[0] == "(":
            if depth == 0:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append((start, m.start()))
    return found


# A word other than those of storage, and what may stand between parameters and a macro behind them.
_TYPED = re.compile(r"\b(?!(?:static|extern|inline|__inline|__inline__|register|_Noreturn)\b)[A-Za-z_]\w*")
_WORDS = re.compile(r"\s*(?:[A-Za-z_]\w*\s*(?:\([^()]*\)\s*)?)*")


def _without_attributes(head: str) -> str:
    """Attribute words and their parentheses as blanks."""
    while m := _ATTRIBUTE.search(head):
        end = m.end()
        if head[end : end + 1] == "(":
            depth = 0
            for p in _PAREN.finditer(head, end):
                depth += 1 if p[0] == "(" else -1
                if depth == 0:
                    end = p.end()
                    break
            else:
                end = len(head)
        head = head[: m.start()] + _spaces(head[m.start() : end]) + head[end:]
    return head


def declarator(head: str, first: bool = False) -> tuple[str, str, int, int] | None:
    """Name, parameter text and span of the function declarator in a head.

    The parameters are the last top-level parentheses (``first``: the first ones with a name before them). If
    they follow other parentheses, these hold the declarator, as in a function that returns a function pointer.
    """
    found = groups(head)
    order = range(len(found)) if first else range(len(found) - 1, -1, -1)
    for k in order:
        start, end = found[k]
        if name := _NAME_BEFORE.search(head, 0, start):
            if not first and (own := _before_macro(head, found[:k], name.start(1))):
                return own
            return name[1], head[start + 1 : end], name.start(1), end + 1
        if k and not head[found[k - 1][1] + 1 : start].strip():
            a, b = found[k - 1]
            if inner := declarator(head[a + 1 : b]):
                return inner[0], inner[1], a + 1 + inner[2], a + 1 + inner[3]
        if not first:
            return None
    return None


def _before_macro(head: str, found: list[tuple[int, int]], stop: int) -> tuple[str, str, int, int] | None:
    """The first declarator with a type before it, where a macro with parentheses stands behind the parameters."""
    for start, end in found:
        name = _NAME_BEFORE.search(head, 0, start)
        if name and name[1] not in TYPE_WORDS and _TYPED.search(head, 0, name.start(1)) and _WORDS.fullmatch(head, end + 1, stop):
            return name[1], head[start + 1 : end], name.start(1), end + 1
    return None


def _listed(text: str) -> list[str]:
    """Parts of a list at its top-level commas."""
    if "(" not in text and "[" not in text:
        return text.split(",")
    parts, depth, start = [], 0, 0
    for m in _NESTING.finditer(text):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    return [*parts, text[start:]]


def parameters(text: str) -> list[str]:
    """Names of a parameter list; unnamed, void and variadic parameters have none."""
    names = []
    for part in _listed(text):
        if "(" in part and (pointer := _FUNCTION_POINTER.match(part)):
            names.append(pointer[1])
            continue
        words = _PARAMETER_WORD.findall(_QUALIFIER.sub(" ", _SUBSCRIPT.sub("", part)))
        if len(words) < 2 or words[-1] == "*" or words[-1] in TYPE_WORDS:
            continue
        if not (len(words) == 2 and words[0] in TAG_WORDS):
            names.append(words[-1])
    return names


def _old_style(piece: str) -> set[str] | None:
    """Parameter names of a definition in the old style, whose first declaration ends the piece."""
    if "(" not in piece or "=" in piece:
        return None
    piece = _without_attributes(piece)
    if not (found := declarator(piece, first=True)):
        return None
    if not _IDENTIFIERS.match(found[1]) or not re.match(r"\s*[A-Za-z_]", piece[found[3] :]):
        return None
    names = {n.strip() for n in found[1].split(",")}
    return names if _declares(piece[found[3] :], names) else None


def _declares(piece: str, names: set[str]) -> bool:
    declared = parameters(piece)
    return bool(declared) and set(declared) <= names


def scan(text: str) -> dict:
    """Functions and rejected blocks of a C text, and how many braces nothing closes.

    Branches that do not count for the braces are scanned by themselves for their complete blocks.
    """
    found, waiting = _scan(text, 0)
    depth = found["open_depth"]
    while waiting:
        start, end, inside = waiting.pop()
        own, inner = _scan(text[start:end], inside)
        waiting += [(start + a, start + b, d) for a, b, d in inner]
        lines = text.count("\n", 0, start)
        found["functions"] += [f | {k: f[k] + lines for k in ("start_line", "end_line")} for f in own["functions"]]
        found["rejects"] += [
            r | {"start_line": r["start_line"] + lines} for r in own["rejects"] if r["reason"] != "never closed"
        ]
    for rows in (found["functions"], found["rejects"]):
        rows.sort(key=lambda r: r["start_line"])
    return found | {"open_depth": depth}


def _scan(text: str, inside: int) -> tuple[dict, list[tuple[int, int, int]]]:
    """One text, and its hidden branches with the depth of blocks around them. ``inside`` is that depth of the text
    itself; blocks count once so many braces are closed."""
    code, conditions = blanked(text)
    hidden: list[tuple[int, int, int]] = []
    if conditions:
        code, hidden = one_branch(code, conditions)
    marks = [(m.start(), m[0]) for m in _MARK.finditer(code)]
    closes: dict[int, int] = {}
    stack: list[int] = []
    for at, mark in marks:
        if mark == "{":
            stack.append(at)
        elif mark == "}" and stack:
            closes[stack.pop()] = at
    lost = set(stack)
    linkage: set[int] = set()
    around = inside
    functions: list[dict] = []
    rejects: list[dict] = []
    start, lines, counted = 0, 1, 0
    old: tuple[int, set[str]] | None = None
    i, place = 0, {at: k for k, (at, _) in enumerate(marks)}

    def line_of(at: int) -> int:
        nonlocal lines, counted
        lines += text.count("\n", counted, at)
        counted = at
        return lines

    while i < len(marks):
        at, mark = marks[i]
        i += 1
        if mark == ";":
            if old and _declares(code[start:at], old[1]):
                start = at + 1
                continue
            names = _old_style(code[start:at])
            old = (start, names) if names else None
            start = at + 1
        elif mark == "}":
            inside = max(inside - 1, 0)
            start, old = at + 1, None
        elif at in lost or (code[start:at].strip() == "extern" and _LINKAGE.search(text, start, at)):
            if at in lost:
                begin = start + len(code[start:at]) - len(code[start:at].lstrip())
                rejects.append({"start_line": line_of(begin), "reason": "never closed"})
            else:
                linkage.add(at)
            start, old = at + 1, None
        else:
            end = closes[at]
            if inside:
                start, old = end + 1, None
                i = place[end] + 1
                continue
            if old and not code[start:at].strip():
                start = old[0]
            head = code[start:at]
            begin = start + len(head) - len(head.lstrip())
            first = line_of(begin)
            function, reason = _function(head.strip(), old is not None)
            if function:
                body = text[begin : end + 1]
                functions.append(
                    function | {"body": body, "start_line": first, "end_line": first + body.count("\n")}
                )
            else:
                rejects.append({"start_line": first, "reason": reason})
            # A type or an initializer goes on to its semicolon.
            start, old = end + 1, None
            i = place[end] + 1
    waiting = _surrounded(hidden, marks, closes, lost | linkage, around)
    return {"functions": functions, "rejects": rejects, "open_depth": len(lost)}, waiting


def _surrounded(hidden, marks, closes, no_scope, around) -> list[tuple[int, int, int]]:
    """Hidden branches with the depth at the conditional they belong to; some braces open no scope."""
    if not hidden:
        return []
    scopes = {at: end for at, end in closes.items() if at not in no_scope}
    ends, places, depths = set(scopes.values()), [], [around]
    paired = {*closes.values()}
    for at, mark in marks:
        if at in scopes or at in ends or (mark == "}" and at not in paired):
            places.append(at)
            depths.append(max(depths[-1] + (1 if mark == "{" else -1), 0))
    return [(start, end, depths[bisect_right(places, first)]) for first, start, end in hidden]


def _function(head: str, old_style: bool) -> tuple[dict | None, str]:
    """Name, signature, parameters and return type of a head, or why it is no function's."""
    if "_" in head:
        head = _without_attributes(head).strip()
    if not head:
        return None, "no head"
    found = declarator(head, first=old_style)
    if found is None:
        return None, "initializer" if "=" in head else "type" if _TAG.search(head) else "no parameter list"
    name, params, start, end = found
    before, after = head[:start], "" if old_style else head[end:]
    if after and not _TRAILING.fullmatch(after) or _TAG.search(after):
        return None, "type" if _TAG.search(after) else "no parameter list before the block"
    if name in CONTROL_WORDS or (first := _FIRST_WORD.match(head)) and first[0] in CONTROL_WORDS:
        return None, "control statement"
    kind = before if _WORDS.fullmatch(after) else f"{before}{after}"
    return {
        "name": name,
        "signature": " ".join(head[start:end].split()),
        "params": [n.strip() for n in params.split(",")] if old_style else parameters(params),
        "return_type": " ".join(_STORAGE.sub(" ", kind).split()),
    }, ""
