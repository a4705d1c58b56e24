"""Declarations of C and C++ sources: kinds and qualified names, statement by statement.

Tokens are cut into statements (at semicolons and braces outside of parentheses) in Arrow batches, each with the scopes that are open around it, and
patterns say what a statement's words declare, once for all statements that differ in names alone. No exchange, and no parser: what macros
make is not seen, and a template's arguments are told by their signs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .lexer import lexed, small_batches

_DECLARED = "struct<decl_kind: string, qualified_name: string, name: string, line: int, col: int>"
#: Words that begin no declaration, and words that are no name of one.
CONTROL = "if for while switch catch return sizeof decltype alignof alignas static_assert noexcept throw new delete else do case goto using friend break continue default requires co_return co_await co_yield".split()
TYPES = "const int char void double float long short unsigned signed bool auto volatile".split()
_WORD = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*+"
_NOT = "(?!(?:" + "|".join(CONTROL) + r")\b)"
#: Words of a statement are joined by one space. What may stand before a declaration: access labels, attributes, template heads, linkage.
_LEAD = r"^(?:(?:public|private|protected) : |\[ \[ [^\]]*+\] \] |template < (?:[^<>]|<[^<>]*+>)*+> |extern \"[^\"]*+\" (?!$))*+"
_MORE = r"(?:static |const |constexpr |inline )*+"
_RECORD = rf"^(typedef )?{_MORE}(class|struct|union)\b(?: (?!final\b)(?:{_WORD}))*?(?: ({_WORD}))?(?: final)?(?: : [^()]*+)?$"
_ENUM = rf"^(typedef )?enum((?: class| struct)?)(?: ({_WORD}))?(?: : [^()]*+)?$"
_SPACE = rf"^(?:inline )?namespace(?: ({_WORD}(?: : : {_WORD})*+))?$"
_FUNCTION = rf"^{_NOT}[^=(]*?(?:^|[ *&>])((?:{_WORD} : : )*+)((?:~ )?{_NOT}{_WORD}) \("
_PATH = rf"{_WORD}(?: : : {_WORD})*+"
_VARIABLES = rf"^{_NOT}{_PATH}(?: {_PATH})*?(?: [*&])*+ ({_WORD})(?: : [0-9A-Za-z_]++)?((?: ,(?: [*&])*+ {_WORD}(?: : [0-9A-Za-z_]++)?)*+)$"


def _re(pattern: str) -> re.Pattern:
    """A pattern as Python spells it."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern))


_LEADS, _SPACES, _ENUMS, _RECORDS, _LINKAGE = map(_re, (_LEAD, _SPACE, _ENUM, _RECORD, '^extern "[^"]*+"$'))
_FUNCTIONS, _VARIABLE, _NAME, _MORE_NAMES = map(_re, (_FUNCTION, _VARIABLES, f"^{_WORD}$", rf",(?: [*&])*+ ({_WORD})"))
_SUBSCRIPT, _ARGUMENTS, _CALLS, _ASSIGNED = map(_re, (r" \[ [^\]]*+\]", r" < [^<>]*+>", r" \([^()]*+\)", " =(?: [^,]*+)?"))
_OPERATOR, _STATIC, _SIGNS, _VALUE = map(_re, (r"\boperator\b", r"\bstatic\b", r"[*&] ", r"^for \( | =(?: |$)"))
_BETWEEN, _LAST, _ENUMERATOR = map(_re, (r"^[^(]*+\(((?:[^()]|\([^()]*+\))*+)\)", rf"^ {_PATH}(?: {_PATH})*?(?: [*&])*+ ({_WORD}) ?$", rf"^ ?({_WORD})"))
_TYPEDEF, _USING, _AHEAD = map(_re, (rf"^typedef .*?(?:\( \* ({_WORD}) \) \(.*|({_WORD})(?: \[ [^\]]*+\])*+)$", rf"^using ({_WORD}) = ", rf"^(class|struct|union) ({_WORD})$"))
_LOOP = _re(r"^for \( (.*?)(?: ;| : (?!: )).*$")
#: Names that are alike to all of these patterns: ASCII, and none of the words that they know.
_ALIKE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_WORDS = frozenset((*C.KEYWORDS["Cpp"], *CONTROL, *TYPES, *"public private protected template extern static const constexpr inline typedef class struct union final enum namespace using operator for".split()))


def _opens(head: str) -> tuple[str, str | None, bool]:
    """(kind, name, typed) of the scope that a brace after these words opens; blocks, functions and initializers ("") have no name."""
    if m := _SPACES.match(head):
        return "namespace", (m[1] or "").replace(" : : ", "::") or None, False
    if _LINKAGE.match(head):
        return "namespace", None, False
    typed = head.startswith("typedef ")
    if m := _ENUMS.match(head):
        return "enum", m[3] if m[2] else None, typed
    if m := _RECORDS.match(head):
        return "record", m[3], typed
    return "", None, False


def _got(text: str, pattern: re.Pattern, group: int) -> str:
    return (m[group] or "") if (m := pattern.search(text)) else ""


def _bare(head: str) -> str:
    """A statement's words without subscripts, arguments of templates and calls (three deep) and what is assigned."""
    for pattern in (_SUBSCRIPT, *[_ARGUMENTS] * 3, *[_CALLS] * 3):
        head = pattern.sub("", head)
    return _ASSIGNED.sub(" ", head).rstrip(" ")


def _said(head: str, ends: str, scope: str, closed: str, opens: str, space: str | None) -> list[tuple[str, str, str]]:
    """(decl_kind, name, own) that a statement declares: what ends it, the kind of the scope around it, what the brace before it closed, what it opens and that
    one's names. own: what leads to the name within the scope, () for names that stand alone."""
    own = "()" if scope == "" else ""  # "": a function, a block or an initializer
    outside = scope not in ("", "enum")
    function, operator = _FUNCTIONS.search(head), _OPERATOR.search(head)
    each = lambda names, kind, own="": [(kind, n, own) for n in names]

    def functions() -> list:
        between = _got(head, _BETWEEN, 1)
        for _ in range(3):
            between = _ARGUMENTS.sub("", between)
        names = [_got(_bare(p), _LAST, 1) for p in between.split(",")]
        return [("function", (function[2] or "").replace("~ ", "~"), (function[1] or "").replace(" : : ", "::")), *each([n for n in names if n and n not in TYPES], "parameter", "()")]

    bare = _bare(_got(head, _LOOP, 1) if head.startswith("for ( ") else head)
    variable = "field" if scope == "record" and not _STATIC.search(head) else "variable"

    def variables() -> list:
        if not (m := _VARIABLE.search(bare)):
            return []
        return each([n for n in (m[1], *_MORE_NAMES.findall(m[2] or "")) if n not in TYPES], variable, own)

    def after() -> list[str]:
        return [n for n in _SIGNS.sub("", bare).split(" , ") if _NAME.search(n)]

    if ends == "{":
        if opens == "namespace":
            return [] if space is None else [("namespace", space.split("::")[-1], space.rpartition("::")[0])]
        if opens == "enum":
            return [("enum", n, own)] if (n := _got(head, _ENUMS, 3)) else []
        if opens == "record":
            return [] if space is None else [(_got(head, _RECORDS, 2), space, own)]
        if outside and function and not operator:
            return functions()
        if not (outside and (function or operator)) and scope != "enum" and (_VALUE.search(head) or "(" not in head):
            return variables()
        return []
    if scope == "enum":
        return each([n for x in bare.split(",") if (n := _got(x, _ENUMERATOR, 1))], "enumerator")
    if ends == "}":
        return []
    if closed == "typed":
        return each(after(), "typedef", own)
    if closed == "record":
        return each(after(), variable, own)
    if head.startswith("typedef "):
        return [("typedef", m[1] or m[2] or "", own)] if (m := _TYPEDEF.search(head)) else []
    if m := _USING.search(head):
        return [("typedef", m[1], own)]
    if m := _AHEAD.search(head):
        return [(m[1], m[2], own)]
    if outside and function and not operator:
        return functions()
    return variables()


#: A name in a statement's shape, by its word's number; shapes that are remembered, and words of one at most.
_HOLE = re.compile("^zq([0-9]+)qz$")
SHAPES, SHAPE = 1 << 15, 64


def _of_shape(shape: tuple[str, ...], ends: str, scope: str, closed: str) -> tuple:
    """What a statement of such words (names that are alike to all patterns are NUL) opens: its kind, the names that lead there (None for none), whether it is
    typed; and what it declares: kind, "~" or "", name, and the names of own (None for names that stand alone). Names are words' numbers, or words."""
    said = [f"zq{i}qz" if w == "\0" else w for i, w in enumerate(shape)]
    head = _LEADS.sub("", " ".join(said), count=1)
    word = lambda x: int(m[1]) if (m := _HOLE.match(x)) else x
    path = lambda x: tuple(word(p) for p in x.split("::") if p)
    opens, space, typed = _opens(head) if ends == "{" else ("", None, False)
    found = _said(head, ends, scope, closed, opens, space) if head else []
    names = [(kind, "~" * name.startswith("~"), word(name.removeprefix("~")), None if own == "()" else path(own)) for kind, name, own in found]
    return opens, None if space is None else path(space), typed, names


_SIGN = {"": 7, "{": 1, "}": 2, ";": 3, "(": 4, "[": 4, ")": 5, "]": 5}
_ENDS = ("", "{", "}", ";", "", "", "", "")


def _declared(batch: pa.Array, remembered: dict) -> pa.Array:
    """_DECLARED of each source. Texts are told once a batch; of tokens only signs are gone through, and statements of one shape are told once."""
    values = batch.flatten()
    coded = values.field("raw").dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    comment = lambda x: x[:2] in ("//", "/*") or x[:1] == "#" and len(x) > 1
    signs = np.array([_SIGN[x] if x in _SIGN else 6 if comment(x) else 0 for x in distinct], np.int8)
    table = np.empty((2, len(distinct)), object)
    table[0, :] = distinct
    table[1, :] = ["\0" if _ALIKE.match(x) and x not in _WORDS else x.replace("\0", "\1") for x in distinct]
    sign = signs[codes]
    words = np.flatnonzero(sign != 6)
    raws, shapes = table[0, codes[words]].tolist(), tuple(table[1, codes[words]].tolist())
    sign = sign[words]
    special = np.flatnonzero(sign)
    kinds, qualified, names, places, bounds = [], [], [], [], [0]
    first, depth, closed = 0, 0, ""
    stack = outermost = [("namespace", "", False)]  # kind, names up to there, typed
    for at, k in zip(special.tolist(), sign[special].tolist(), strict=True):
        if k == 4:
            depth += 1
            continue
        if k == 5:
            depth -= depth > 0
            continue
        if depth and k != 7:
            continue
        scope, around, typed = stack[-1]
        opens, space, alias = "", None, False
        if at > first:
            shape = shapes[first:at]
            key = shape, k, scope, closed
            told = remembered.get(key)
            if told is None:
                told = _of_shape(shape, _ENDS[k], scope, closed)
                if at - first <= SHAPE:
                    if len(remembered) >= SHAPES:
                        remembered.clear()
                    remembered[key] = told
            opens, space, alias, said = told
            for kind, tilde, name, own in said:
                if name.__class__ is int:
                    name = raws[first + name]
                try:
                    place = words[raws.index(name, first, at)]  # a name stands where its statement first says it
                except ValueError:
                    place = -1
                name = tilde + name
                lead = () if own is None else (*([around] if around else ()), *[raws[first + x] if x.__class__ is int else x for x in own])
                kinds.append(kind)
                names.append(name)
                qualified.append("::".join((*lead, name)) if lead else name)
                places.append(place)
            if space is not None:
                space = "::".join([raws[first + x] if x.__class__ is int else x for x in space])
        closed = ""
        if k == 1:
            stack.append((opens, f"{around}::{space}" if around and space else space or around, alias))
        elif k == 2 and len(stack) > 1:
            closed = "typed" if typed else "record" if scope in ("record", "enum") else ""
            stack.pop()
        first, depth = at + 1, 0
        if k == 7:
            bounds.append(len(kinds))
            stack, closed = outermost[:1], ""
    place = pa.array([None if x < 0 else x for x in places], pa.int64())
    columns = [pa.array(kinds, pa.string()), pa.array(qualified, pa.string()), pa.array(names, pa.string()), *(values.field(c).take(place) for c in ("line", "col"))]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["decl_kind", "qualified_name", "name", "line", "col"]))


def declared(tokens: Column) -> Column:
    """array of _DECLARED of a source's tokens, the last of them empty."""
    remembered: dict = {}

    @F.arrow_udf(f"array<{_DECLARED}>")
    def cut(batch: pa.Array) -> pa.Array:
        return _declared(batch, remembered)

    return cut(tokens)


def declarations(sources: DataFrame) -> DataFrame:
    """(row, file, decl_kind, qualified_name, name, line, col, system) of C and C++ sources (file, source): what grammars.declaration_findings takes.

    decl_kind: namespace, class, struct, union, enum, enumerator, field, variable, function, parameter, typedef. Qualified names go through named
    namespaces, records and scoped enums; within functions names stand alone. Operators are no declarations, nor is what
    stands within parentheses, but for parameters and the variables of loops. Files below /usr are system files.
    Null sources are empty; statements of any length are read whole.
    """
    text = F.coalesce("source", F.lit(""))
    small_batches(sources.sparkSession)
    rows = sources.select(F.monotonically_increasing_id().alias("row"), "file", text.alias("_text"))
    cut = declared(lexed(F.col("_text"), F.lit("Cpp"), False))  # exploded as it is: of a column of its own, a filter on it would be read below, where sources lie in few tasks
    rows = rows.select("row", "file", F.explode(cut).alias("x")).select("row", "file", "x.*")
    return rows.select("*", F.coalesce(F.col("file").startswith("/usr/"), F.lit(False)).alias("system"))
