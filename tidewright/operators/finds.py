"""What rules find in a source, told where sources are cut, for whatever needs a source and its findings at once.

A finding's texts hang on its token's text and facts alone, so that they are made once for each distinct name and remembered; conditions and texts are those of
rules.local_findings and rules.file_findings, which tests hold these against.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions import constants as C
from ..functions.text import LOWER, UPPER
from . import marks as M

_PLAIN, _LOW, _PASSED = str.maketrans(C.STRIPPED, C.BASES), str.maketrans(UPPER, LOWER), frozenset(C.PASSED)
_BEYOND, _HUMP, _JOINED, _WORD = (re.compile(p) for p in (r"[^\x00-\x7F]", "([^A-Z])([A-Z])", "(?s).[̀-ͯ]", "[A-Za-z]"))
_PHONE = re.compile(C.PHONE, re.ASCII)  # letters are alike in ASCII alone, as columns have it
_DOMINANT = ("snake_case", "camelCase", "PascalCase", "SCREAMING_SNAKE")
_ENCODING, _PURE, _MIXED, _TRANSLIT = M._KIND["EncodingDecl"], *(M._CLASS[c] for c in ("PureVietnamese", "MixedVietnamese", "TransliteratedViet"))
#: (source_rule, rule_id, severity, message, identifier, fixes, line, col, start, end)
Found = tuple[str, str, str, str, str, list[str], int, int, int, int]


def plain_of(name: str) -> str:
    """functions.text.ascii_name of a name."""
    return name if name.isascii() else _BEYOND.sub("?", name.translate(_PLAIN))


def _says(rule: str, name: str) -> str:
    return C.MESSAGES[rule][0] + name + C.MESSAGES[rule][1]


def local(raw: str, facts: int, python: bool, rules: frozenset[str]) -> tuple:
    """The findings that a token makes by itself, but for its place."""
    out, cls = [], facts >> M._CLASS_AT & 7
    add = lambda source, rule, severity, message, name, *fixes: source in rules and out.append((source, rule, severity, message, name, list(fixes)))
    low = raw.translate(_LOW) if facts & M.NAME else ""
    if cls in (_PURE, _MIXED):
        plain = plain_of(raw)
        add("VL001", "VL001", "warning", _says("VL001", raw), raw, _HUMP.sub(r"\1_\2", plain).translate(_LOW), plain[:1].translate(_LOW) + plain[1:])
        if cls == _MIXED:
            add("VL001", "VL002", "warning", _says("VL001_MIXED", raw), raw, plain)
    if cls == _TRANSLIT:
        add("VL001", "VL003", "info", _says("VL001_PLAIN", raw), raw)
        if low not in _PASSED:
            add("VL004", "VL004", "info", _says("VL004", raw), raw, plain_of(raw))
    if facts & M.COMMENT and _WORD.search(raw):
        add("VL002", "VL002", "info", C.MESSAGES["VL002"], "")
    if python and facts & 31 == _ENCODING and "utf-8" not in raw and "utf8" not in raw:
        add("VL003", "VL003", "warning", C.MESSAGES["VL003"], "", "# -*- coding: utf-8 -*-")
    if facts & M.NAME and _JOINED.search(raw):
        add("VL005", "VL005", "error", _says("VL005", raw), raw)
    if facts & M.STRING:
        add("VL007", "VL007", "info", C.MESSAGES["VL007"], "")
    if facts & M.PHONE and _PHONE.search(raw):
        add("VL-EX-001", "VL-EX-001", "warning", _says("VL-EX-001", raw), raw, "phone_number", "phoneNumber")
    if facts & M.SHORT and len(raw.encode()) == 2:
        add("VL-EX-002", "VL-EX-002", "info", _says("VL-EX-002", raw) + C.SHORT[low], raw)
    return tuple(out)


def _in_file(raw: str, facts: int, language: str | None, counts: list[int], flags: list[bool], rules: frozenset[str]) -> Iterator[tuple]:
    """The findings that a token makes in its file, but for its place: counts and flags are M._MARKS and M._FLAGS."""
    first, raised, previous_as, undocumented = flags
    if first and "VL006" in rules:
        styles, total = counts[:4], sum(counts[:4])
        top = styles.index(max(styles))
        if total and sum(i != top and n * 20 > total for i, n in enumerate(styles)) >= 2:
            yield "VL006", "VL006", "info", _says("VL006", _DOMINANT[top]), "", []
    snake, camel = counts[4:]
    if snake and camel and facts & (M.SNAKE if snake < camel else M.CAMEL) and "VL008" in rules:
        yield "VL008", "VL008", "warning", _says("VL008", raw) + ("snake_case" if snake >= camel else "camelCase") + ".", raw, []
    if raised and facts & M.STRING and "VL009" in rules:
        yield "VL009", "VL009", "warning", C.MESSAGES["VL009"], "", []
    if undocumented and language == "Python" and "VL010" in rules:
        yield "VL010", "VL010", "info", _says("VL010", raw), raw, []
    if previous_as and raw != "as" and facts & M.VIET and language in ("Python", "JavaScript") and "VL011" in rules:
        yield "VL011", "VL011", "warning", _says("VL011", raw), raw, []


def finder(rules: list[str], severities: dict[str, str]) -> Callable[[pa.Array, pa.Array, list[str | None]], Iterator[Iterator[Found]]]:
    """A function of texts, their languages and why some can't be lexed (null ones, which have a VL000 each), to each text's findings in order of its tokens.
    ``severities`` are by the registering rule."""
    asked = frozenset(rules)
    one = lambda raw, facts, python: tuple((f[0], f[1], severities.get(f[0], f[2]), *f[3:]) for f in local(raw, facts, python, asked))
    remembered = lru_cache(M.REMEMBERED)(one)
    changed = any(r in severities for r in ("VL006", "VL008", "VL009", "VL010", "VL011"))

    def found(texts: pa.Array, languages: pa.Array, why: list[str | None]) -> Iterator[Iterator[Found]]:
        places, kept, facts, counts, flags = M.found_at(texts, languages, rules)
        upto = np.searchsorted(places.whose[kept], np.arange(len(texts) + 1)).tolist()
        raws = places.raw.take(pa.array(kept)).to_pylist()
        who = places.whose[kept]
        facts, line, col = facts.tolist(), places.line(kept).tolist(), (places.at[kept] - places.since[kept] + 1).tolist()
        start, end = (places.at[kept] - places.begin[who]).tolist(), (places.ends[kept] - places.begin[who]).tolist()
        some = np.any(flags, axis=0) | (counts[4] > 0) & (counts[5] > 0)  # nothing else can be found by a file's rules
        some, of_file = some.tolist(), languages.to_pylist()

        def of(i: int) -> Iterator[Found]:
            if why[i] is not None:
                yield "VL000", "VL000", "error", "Lexer error: " + why[i], "", [], 1, 1, 0, 0
                return
            language = of_file[i]
            for k in range(upto[i], upto[i + 1]):
                raw = raws[k]
                place = line[k], col[k], start[k], end[k]
                for f in (remembered if len(raw) <= M.LONG else one)(raw, facts[k], language == "Python"):
                    yield f + place
                if some[k]:
                    for f in _in_file(raw, facts[k], language, [int(m[k]) for m in counts], [bool(x[k]) for x in flags], asked):
                        if changed:
                            f = (f[0], f[1], severities.get(f[0], f[2]), *f[3:])
                        yield f + place

        return map(of, range(len(texts)))

    return found
