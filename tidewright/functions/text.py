"""Functions of identifiers and text, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def has_vietnamese(s: Column) -> Column:
    """The quick test. ASCII is passed over by its lengths, here and in what follows, as most names are."""
    return ~is_ascii(s) & s.rlike(C.FAST)


def has_exact(s: Column) -> Column:
    return s.rlike(C.EXACT)


def count_vietnamese(s: Column) -> Column:
    return F.when(has_vietnamese(s), F.regexp_count(s, F.lit(C.EXACT))).otherwise(0)


def vietnamese_tokens(s: Column) -> Column:
    """Maximal identifier runs with an exact code point; none if the quick test says no."""
    runs = F.regexp_extract_all(s, F.lit(r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*"), F.lit(0))
    return F.when(has_vietnamese(s), F.filter(runs, lambda x: x.rlike(C.EXACT))).otherwise(F.array().cast("array<string>"))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def marked_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(C.EXACT))


def letter_count(s: Column) -> Column:
    """Code points but underscores and hyphens."""
    return F.length(F.translate(s, "_-", ""))


def vietnamese_ratio(s: Column) -> Column:
    n = letter_count(s)
    return F.when(n == 0, 0.0).otherwise(marked_count(s) / n)


def naming_style(s: Column) -> Column:
    upper, lower = s.rlike("[A-Z]"), s.rlike("[a-z]")
    return (
        F.when(s == "", "Unknown")
        .when(F.octet_length(s) == 1, "SingleLetter")
        .when(F.instr(s, "-") > 0, "KebabCase")
        .when((F.instr(s, "_") > 0) & ~lower, "ScreamingSnake")
        .when(F.instr(s, "_") > 0, "SnakeCase")
        .when(upper & lower & s.rlike("^[A-Z]"), "PascalCase")
        .when(upper & lower & s.rlike("^[a-z]"), "CamelCase")
        .otherwise("Unknown")
    )


def is_transliteration(s: Column) -> Column:
    """The whole name, or each of two parts or more between underscores, is in the word list."""
    low = F.when(s.rlike("[A-Z]"), ascii_lower(s)).otherwise(s)
    bare = F.regexp_replace(low, "^_+|_+$", "")
    parts = F.filter(F.split(bare, "_"), lambda p: p != "")
    words = [F.lit(w) for w in C.WORDS]
    whole = bare.isin(C.WORDS) | ((F.size(parts) >= 2) & F.forall(parts, lambda p: F.array_contains(F.array(*words), p)))
    return F.when(F.instr(s, "_") > 0, whole).otherwise(low.isin(C.WORDS))  # most names are one word


def identifier_class(s: Column) -> Column:
    plain = is_ascii(s) | ~has_exact(s)  # most names are ASCII
    marked = marked_count(s)
    return (
        F.when(F.octet_length(s).between(2, 5) & s.isin(C.ABBREVIATIONS), "Abbreviation")
        .when(plain & is_transliteration(s), "TransliteratedViet")
        .when(plain, "PureASCII")
        .when(marked * 10 >= letter_count(s) * 9, "PureVietnamese")
        .otherwise("MixedVietnamese")
    )


#: The trust in each class.
CONFIDENCE = {"Abbreviation": 0.85, "TransliteratedViet": 0.72, "PureASCII": 0.95, "PureVietnamese": 0.88, "MixedVietnamese": 0.80}


def class_confidence(cls: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), cls)


def ascii_name(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, C.STRIPPED, C.BASES), r"[^\x00-\x7F]", "?")


def snake_name(s: Column) -> Column:
    return ascii_lower(F.regexp_replace(ascii_name(s), "([^A-Z])([A-Z])", "$1_$2"))


def camel_name(s: Column) -> Column:
    a = ascii_name(s)
    return F.concat(ascii_lower(F.substring(a, 1, 1)), F.substring(a, 2, 1 << 30))


def corpus_label(s: Column) -> Column:
    """The corpus builder's label: 0 plain, 1 Vietnamese, 2 mixed, 3 transliterated, 4 abbreviation, 5 none."""
    bare = F.lower(F.translate(s, "_-", ""))
    spaced = F.lower(F.regexp_replace(s, r"\s", ""))
    plain = (
        F.when(bare.isin(C.CORPUS_WORDS) | spaced.isin(C.CORPUS_WORDS), 3)
        .when((F.length(s) <= 6) & s.rlike(C.CORPUS_ABBREVIATION), 4)
        .otherwise(0)
    )
    marked, letters = marked_count(s), F.regexp_count(s, F.lit("[A-Za-z]"))
    return F.when(~has_exact(s), plain).when(marked * 100 >= (marked + letters) * 85, 1).otherwise(2)


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return (
        F.when(ext == "py", "Python").when(ext.isin("js", "mjs", "cjs"), "JavaScript").when(ext.isin("ts", "tsx"), "TypeScript")
        .when(ext.isin("c", "h"), "C").when(ext.isin("cpp", "cxx", "cc", "hpp", "hxx"), "Cpp").otherwise("Unknown")
    )


def escape_json(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    for code in (*range(9), 11, 12, *range(14, 32)):
        s = F.replace(s, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return s


def hex4(s: Column) -> Column:
    """The number of four hexadecimal digits; null for anything else."""
    return F.when(s.rlike("^[0-9A-Fa-f]{4}$"), F.conv(s, 16, 10).cast("int"))


def utf8_of(code: Column) -> Column:
    """A code point's character; U+FFFD for surrogates and numbers beyond Unicode."""
    good = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    quad = F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0"))
    return F.decode(quad, "UTF-32")


def is_leading_byte(byte: Column) -> Column:
    """Whether a byte may begin a character."""
    return (byte < 0x80) | byte.between(0xC2, 0xF4)


def is_valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


_POINT = "struct<codepoint: int, byte_offset: int, byte_length: int, is_vietnamese: boolean, is_id_start: boolean, is_id_continue: boolean>"


def _points(texts: pa.Array) -> pa.Array:
    """The code points of each text, all of a batch at once; no text, no points."""
    each = [np.frombuffer((t.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int32) for t in texts]
    counts = np.array([len(x) for x in each], np.int64)
    c = np.concatenate([*each, np.zeros(0, np.int32)])
    size = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)).astype(np.int32)
    at = np.cumsum(size, dtype=np.int64) - size
    first = (np.cumsum(counts) - counts)[counts > 0]
    at -= np.repeat(at[first], counts[counts > 0])
    within = lambda *ranges: np.any([(c >= a) & (c <= b) for a, b in ranges], axis=0)
    starts = within((0x41, 0x5A), (0x61, 0x7A), (0x5F, 0x5F), (0x80, 0x10FFFF))
    fields = {"codepoint": c, "byte_offset": at.astype(np.int32), "byte_length": size, "is_vietnamese": within(*C.EXACT_RANGES), "is_id_start": starts, "is_id_continue": starts | within((0x30, 0x39))}
    points = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), points)


def code_points(s: Column) -> Column:
    """array of struct(codepoint, byte_offset, byte_length, is_vietnamese, is_id_start, is_id_continue), offsets from 0."""

    @F.arrow_udf(f"array<{_POINT}>")
    def points(texts: pa.Array) -> pa.Array:
        return _points(texts)

    return points(F.make_valid_utf8(s))


def position_of(source: Column, offset: Column) -> Column:
    """struct(line, column, offset) of a byte offset: line and column from 1, the column in code points; offsets past the end are the end."""
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(source))
    before = F.decode(F.substring(F.encode(source, "UTF-8"), F.lit(1), at), "UTF-8")
    return F.struct((F.regexp_count(before, F.lit("\n")) + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"), at.alias("offset"))


def corpus_confidence(s: Column) -> Column:
    """The corpus builder's trust in its own labels."""
    return F.when(has_exact(s), 0.75).when(corpus_label(s) == 3, 0.80).otherwise(0.70)
