"""Sources to the tokens that rules may find something at, with what rules ask of the rest of their file.

Tokens lie in order where a source is cut, and all that rules ask of a token but its place is told by its text and language: a batch's distinct
texts are told once, and what stands before or after a token, and how many of a kind a file has, are passes over the batch's numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import LOWER, UPPER, has_vietnamese
from .lexer import _OF, KINDS_OF_COMMENTS, KINDS_OF_NAMES, Places, _cut, small_batches

KINDS = (
    "EndOfFile", "Keyword", *KINDS_OF_NAMES, "EncodingDecl", *KINDS_OF_COMMENTS, "TemplateLiteral", "StringLiteral", "Newline", "Whitespace", "NumberLiteral", "Decorator", "Punctuation", "Operator",
)
CLASSES = ("", "Abbreviation", "TransliteratedViet", "PureASCII", "PureVietnamese", "MixedVietnamese")
STYLES = ("", "SnakeCase", "CamelCase", "PascalCase", "ScreamingSnake")
_KIND, _CLASS, _STYLE = ({v: i for i, v in enumerate(x)} for x in (KINDS, CLASSES, STYLES))
#: A token's facts in one number: its kind, class and style, whether it is a word of raise, def or as, and what rules may find it by.
_CLASS_AT, _STYLE_AT = 5, 8
RAISE, PASSES, DEF, NAME, AS, CLEAR, SNAKE, CAMEL, VIET, TRANSLIT, COMMENT, STRING, ENCODING, PHONE, SHORT = (1 << i for i in range(11, 26))
#: By rule: the tokens that it may find something at. VL006 finds at a file's first one.
_AT = {
    "VL001": VIET, "VL002": COMMENT, "VL003": ENCODING, "VL004": TRANSLIT, "VL005": VIET, "VL006": 0, "VL007": STRING, "VL008": SNAKE | CAMEL, "VL009": STRING, "VL010": TRANSLIT, "VL011": VIET, "VL-EX-001": PHONE, "VL-EX-002": SHORT,
}
#: Texts that are remembered between batches: so many at most, and so long.
REMEMBERED, LONG = 1 << 17, 64

_FAST, _EXACT, _PHONE = (re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", p)) for p in (C.FAST, C.EXACT, C.PHONE))
_LETTER, _UPPER_LATER = re.compile("[A-Za-z_]"), re.compile("(?s).[^A-Z]*[A-Z]")
_KEYWORDS = {k: frozenset(v) for k, v in C.KEYWORDS.items()}
_WORDS, _ABBREVIATIONS = frozenset(C.WORDS), frozenset(C.ABBREVIATIONS)
_LOW = str.maketrans(UPPER, LOWER)


def kind_of(raw: str, language: str, first: bool, marked: bool) -> str:
    """lexer.token_kind of a text, ``first`` in its source or not."""
    native, script = language == "Cpp", language == "JavaScript"
    python = not native and not script
    c = raw[:1]
    if not c:
        return "EndOfFile"
    if (c.isascii() and (c.isalpha() or c == "_") or c >= "\x80") and not (native and raw.startswith('R"')):
        if not marked and raw in _KEYWORDS[language]:
            return "Keyword"
        return "Identifier" if not marked else "MixedIdentifier" if _LETTER.search(raw) else "VietnameseIdentifier"
    if python and first and c == "#":
        return "EncodingDecl" if "coding" in raw else "Comment"
    if c == "#" if python else raw.startswith("//"):
        return "VietnameseComment" if marked else "Comment"
    if raw.startswith(('"""', "'''")) if python else raw.startswith("/*"):
        return "VietnameseComment" if marked else "BlockComment"
    if script and c == "`":
        return "TemplateLiteral"
    if c in "\"'" or native and raw.startswith('R"'):
        return "StringLiteral"
    if raw == "\n":
        return "Newline"
    if c in " \t\r\x0b\x0c":
        return "Whitespace"
    if "0" <= c <= "9":
        return "NumberLiteral"
    if python and c == "@":
        return "Decorator"
    return "Operator" if native and not (c == "#" and len(raw) > 1) else "Punctuation"


def class_of(name: str) -> str:
    """functions.text.identifier_class of a name."""
    if name in _ABBREVIATIONS:
        return "Abbreviation"
    marked = 0 if name.isascii() else len(_EXACT.findall(name))
    if marked:
        letters = len(name) - name.count("_") - name.count("-")
        return "PureVietnamese" if marked * 10 >= letters * 9 else "MixedVietnamese"
    low = name.translate(_LOW)
    if low in _WORDS:
        return "TransliteratedViet"
    if "_" in low:
        parts = [p for p in low.split("_") if p]
        if low.strip("_") in _WORDS or (len(parts) >= 2 and _WORDS.issuperset(parts)):
            return "TransliteratedViet"
    return "PureASCII"


def style_of(name: str) -> str:
    """functions.text.naming_style of a name, where it is one of STYLES."""
    upper, lower = name.translate(_LOW) != name, any("a" <= c <= "z" for c in name)
    if len(name.encode()) < 2 or "-" in name:
        return ""
    if "_" in name:
        return "SnakeCase" if lower else "ScreamingSnake"
    if not (upper and lower):
        return ""
    return "PascalCase" if "A" <= name[0] <= "Z" else "CamelCase" if "a" <= name[0] <= "z" else ""


def _told(raw: str, language: str, first: bool = False) -> int:
    marked = not raw.isascii() and _FAST.search(raw) is not None
    kind = kind_of(raw, language, first, marked)
    out = _KIND[kind]
    if raw in ("raise", "throw"):
        out |= RAISE
    elif kind not in KINDS_OF_NAMES and kind != "Punctuation":
        out |= PASSES
    if raw == "as":
        out |= AS
    if kind in KINDS_OF_NAMES:
        cls = class_of(raw)
        out |= NAME | _CLASS[cls] << _CLASS_AT | _STYLE[style_of(raw)] << _STYLE_AT
        if cls == "TransliteratedViet":
            out |= VIET | TRANSLIT | (SNAKE if "_" in raw else CAMEL if _UPPER_LATER.match(raw) else 0)
        elif cls in ("PureVietnamese", "MixedVietnamese"):
            out |= VIET
        out |= (PHONE if _PHONE.search(raw) else 0) | (SHORT if raw.translate(_LOW) in C.SHORT else 0)
    elif kind == "Keyword" and raw == "def":
        out |= DEF
    elif kind == "StringLiteral":
        out |= STRING if marked else CLEAR
    elif kind in KINDS_OF_COMMENTS and marked:
        out |= COMMENT
    elif kind == "EncodingDecl":
        out |= ENCODING
    return out


_remembered = lru_cache(REMEMBERED)(_told)


def told(raw: str, language: str) -> int:
    """The facts of a text that is not its source's first."""
    return _remembered(raw, language) if len(raw) <= LONG else _told(raw, language)


def _before(mark: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the last one before it in its file (``first``: where that begins) that is marked; -1 for none."""
    last = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    last = np.concatenate([[-1], last[:-1]])
    return np.where(last >= first, last, -1)


def _undocumented(facts: np.ndarray, who: np.ndarray, line: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Transliterated names after def which no string without marks follows before a token over five lines on, or before the next such name."""
    defines = (facts & DEF) > 0
    at = _before(defines | ((facts & NAME) > 0), first)
    named = ((facts & NAME) > 0) & (at >= 0) & defines[at]
    clear = (facts & CLEAR) > 0
    opens = np.flatnonzero(named & ((facts & TRANSLIT) > 0))
    other = np.flatnonzero(~clear & ~named & ~defines)
    key = who.astype(np.int64) << 32 | line
    n = len(facts)
    following = lambda places, k: np.append(places, n)[k]
    late = following(other, np.searchsorted(key[other], key[opens] + 5, side="right"))
    cleared = following(np.flatnonzero(clear), np.searchsorted(np.flatnonzero(clear), opens))
    found = (late < cleared) & (late < np.append(opens[1:], n)) & (np.append(who, -1)[late] == who[opens])
    out = np.zeros(n, bool)
    out[opens[found]] = True
    return out


_MARKS = ("snake_case", "camelCase", "PascalCase", "SCREAMING_SNAKE", "s", "c")
_FLAGS = ("first", "raised", "previous_as", "flag")
_TOKEN = "struct<pos: int, raw: string, start: int, line: int, col: int, facts: int, " + ", ".join([f"{m}: int" for m in _MARKS] + [f"{f}: boolean" for f in _FLAGS]) + ">"


def found_at(texts: pa.Array, languages: pa.Array, rules: list[str]) -> tuple[Places, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The pieces of all texts; which of them are tokens that one of the rules may find something at; their facts, and by _MARKS and _FLAGS their marks. Of a null
    text its end alone."""
    family = [_OF.get(x, "Python") for x in languages.to_pylist()]
    raw, counts = _cut(texts.fill_null(""), languages)
    places = Places(raw, counts)
    tokens = places.tokens()
    who = places.whose[tokens]
    coded = raw.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()[tokens]
    tables = {f: np.fromiter((told(x, f) for x in distinct), np.int64, len(distinct)) for f in set(family)}
    if len(tables) < 2:
        facts = next(iter(tables.values()), np.zeros(0, np.int64))[codes]
    else:
        names = list(tables)
        facts = np.stack([tables[f] for f in names])[np.array([names.index(f) for f in family])[who], codes]
    first = np.searchsorted(who, np.arange(len(counts)))  # each file has a token, its end
    for i in first:
        if family[who[i]] == "Python" and tokens[i] == places.upto[who[i]] and facts[i] & 31 in (_KIND["Comment"], _KIND["VietnameseComment"]):
            facts[i] = _told(distinct[codes[i]], "Python", True)
    start = first[who]
    line = places.line(tokens)
    is_first = np.arange(len(tokens)) == start
    mask = 0
    for r in rules:
        mask |= _AT.get(r, 0)
    kept = (facts & mask) > 0
    if "VL006" in rules:
        kept |= is_first
    kept[first[texts.is_null().to_numpy(zero_copy_only=False)]] = True
    files = len(counts)
    count = lambda which: np.bincount(who[which], minlength=files)
    style = facts >> _STYLE_AT & 7
    marks = [count(style == i) for i in range(1, len(STYLES))] + [count((facts & SNAKE) > 0), count((facts & CAMEL) > 0)]
    raising = (facts & RAISE) > 0
    last = _before(raising | ((facts & PASSES) > 0), start)
    previous = np.concatenate([[False], (facts[:-1] & AS) > 0]) & ~is_first
    flags = [is_first, (last >= 0) & raising[last], previous, _undocumented(facts, who, line, start)]
    at = np.flatnonzero(kept)
    return places, tokens[at], facts[at], [m[who[at]] for m in marks], [x[at] for x in flags]


def _kept(texts: pa.Array, languages: pa.Array, rules: list[str]) -> pa.Array:
    """By text: the tokens that one of the rules may find something at, with their marks."""
    places, kept, facts, marks, flags = found_at(texts, languages, rules)
    columns = [pa.array(x.astype(np.int32)) for x in (facts, *marks)] + [pa.array(x) for x in flags]
    return places.lists(kept, None, columns, ["facts", *_MARKS, *_FLAGS])


def marked_tokens(sources: DataFrame, rules: list[str]) -> DataFrame:
    """The tokens of (file, source, language) that ``rules`` may find something at, with the columns of lexer.tokens, their class and the marks of rules.in_file;
    of a null source its end. Nothing is shuffled. ``row`` and ``_why`` are kept where sources have them."""
    row = F.col("row") if "row" in sources.columns else F.monotonically_increasing_id()
    small_batches(sources.sparkSession)
    rules = list(rules)

    @F.arrow_udf(f"array<{_TOKEN}>")
    def kept(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return _kept(texts, languages, rules)

    why = F.col("_why") if "_why" in sources.columns else F.lit(None).cast("string")
    rows = sources.select(row.alias("row"), "file", "language", why.alias("_why"), F.col("source").alias("_text"))  # before the explode, as rows are numbered here
    rows = rows.select("row", "file", "language", "_why", F.explode(kept(F.make_valid_utf8("_text"), F.col("language"))).alias("_kept"))
    part = lambda names, shift: F.get(F.array(*map(F.lit, names)), F.shiftright("_kept.facts", shift).bitwiseAND(31 if not shift else 7))
    has = lambda bit: F.col("_kept.facts").bitwiseAND(bit) > 0
    marks = [F.col(f"_kept.{m}").alias(f"_{m}") for m in (*_MARKS, *_FLAGS)]
    raw, start = F.col("_kept.raw"), F.col("_kept.start")
    return rows.select(
        "row", "file", "language", "_why", "_kept.pos", part(KINDS, 0).alias("kind"), "_kept.raw", "_kept.start", (start + F.octet_length(raw)).alias("end"), "_kept.line", "_kept.col",
        has_vietnamese(raw).alias("has_vietnamese"), F.nullif(part(CLASSES, _CLASS_AT), F.lit("")).alias("cls"), has(SNAKE).alias("_snake"), has(CAMEL).alias("_camel"), *marks,
    )
