"""Sources to tokens: one total pattern a language cuts them in Arrow batches, positions are sums over a batch's pieces; kinds are column expressions."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import has_vietnamese

KINDS_OF_NAMES = ("Identifier", "VietnameseIdentifier", "MixedIdentifier")
BLANK = "^[ \\t\\r\\x0B\\x0C]"
KINDS_OF_COMMENTS = ("Comment", "BlockComment", "VietnameseComment")


#: Sources in an Arrow batch at most, as one may be very long.
BATCH = 512
#: Characters of a source whose pieces are cut at once, and pieces that are Python strings at a time in longer ones.
SHORT, PIECES = 1 << 20, 1 << 18
#: Bytes that pieces without a token begin with.
SPACE = np.isin(np.arange(256), list(b" \t\r\n\x0b\x0c"))
_TOKEN = "struct<pos: int, raw: string, start: int, line: int, col: int>"


def _pattern(total: str) -> re.Pattern:
    """A total pattern as Python spells it; names and blanks, which begin as nothing else does (but for raw strings), are tried first."""
    whole = f'(?!R"){C.IDENTIFIER}|[ \\t\\r\\x0B\\x0C]+|{total}'.replace(r"\z", r"\Z").replace("(?md:^)", "(?m:^)")
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", whole))


_PATTERNS = {name: _pattern(total) for name, total in (("Python", C.PYTHON), ("JavaScript", C.JAVASCRIPT), ("Cpp", C.CPP))}
#: For sources of C and C++ without a raw string, whose pattern has a group: the others are cut without a match for each piece.
_NOT_RAW = _pattern(C.CPP.replace(C.RAW_STRING + "|", ""))
_OF = {"JavaScript": "JavaScript", "TypeScript": "JavaScript", "C": "Cpp", "Cpp": "Cpp"}


def _cut(texts: pa.Array, languages: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces of all texts, an empty one after each text's last, and the number of each text's (0 for null)."""
    parts, held, counts = [], [], np.zeros(len(texts), np.int64)
    for i, (text, language) in enumerate(zip(texts, languages, strict=True)):
        text = text.as_py()
        if text is None:
            continue
        pattern = _PATTERNS[_OF.get(language.as_py(), "Python")]
        if pattern.groups and 'R"' not in text:
            pattern = _NOT_RAW
        if len(text) <= SHORT:
            found = iter([pattern.findall(text) if not pattern.groups else [m[0] for m in pattern.finditer(text)]])
        else:
            every = (m[0] for m in pattern.finditer(text))
            found = iter(lambda every=every: list(islice(every, PIECES)), [])
        for some in found:
            held += some
            counts[i] += len(some)
            if len(held) >= PIECES:
                parts.append(pa.array(held, pa.string()))
                held = []
        held.append("")
        counts[i] += 1
    return pa.concat_arrays([*parts, pa.array(held, pa.string())]), counts


class Places:
    """Where the pieces of a batch stand, by sums over all of them that begin anew with each text."""

    def __init__(self, raw: pa.Array, counts: np.ndarray):
        self.raw, self.counts = raw, counts
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        self.data, self.at, self.ends = data, ends[:-1], ends[1:]
        at, ends = self.at, self.ends
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        here = counts > 0
        self.whose, first = np.repeat(np.arange(len(counts)), counts), self.upto[:-1][here]
        breaks = pc.count_substring(raw, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.lines = np.cumsum(breaks) - breaks
        since = np.zeros(len(raw) + 1, np.int64)  # where the line after a piece begins, if it breaks one
        broken = np.flatnonzero(breaks)
        since[broken + 1] = ends[broken]
        for k in broken[ends[broken] - at[broken] > 1]:
            since[k + 1] -= len(raw[k].as_py().rpartition("\n")[2].encode())
        since = since[:-1]
        since[first] = at[first]
        self.since = np.maximum.accumulate(since) if len(since) else since
        self.begin = np.zeros(len(counts), np.int64)
        self.begin[here] = at[first]
        self.before = np.zeros(len(counts), np.int64)
        self.before[here] = self.lines[first]
        self.empty = ends == at

    def tokens(self) -> np.ndarray:
        """Pieces that are no blanks."""
        return np.flatnonzero(self.empty | ~SPACE[self.data[np.where(self.empty, 0, self.at)]] if len(self.data) else self.empty)

    def line(self, kept: np.ndarray) -> np.ndarray:
        return self.lines[kept] - self.before[self.whose[kept]] + 1

    def lists(self, kept: np.ndarray, mask: pa.Array | None, columns: list[pa.Array], names: list[str]) -> pa.Array:
        """By text: its pieces of ``kept`` with their places and more columns."""
        who = self.whose[kept]
        values = [kept - self.upto[:-1][who], None, self.at[kept] - self.begin[who], self.line(kept), self.at[kept] - self.since[kept] + 1]
        placed = [self.raw.take(pa.array(kept)) if v is None else pa.array(v.astype(np.int32)) for v in values]
        tokens = pa.StructArray.from_arrays(placed + columns, ["pos", "raw", "start", "line", "col", *names])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(self.counts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), tokens, mask=mask)


def _placed(texts: pa.Array, languages: pa.Array, keep_space: bool, marked: bool = False) -> pa.Array:
    """Each text's tokens with their places; of marked ones, those that aren't ASCII and the last."""
    places = Places(*_cut(texts, languages))
    kept = np.arange(len(places.raw)) if keep_space else places.tokens()
    if marked:
        beyond = np.concatenate([[0], np.cumsum(places.data >= 0x80)])
        kept = kept[(beyond[places.ends] > beyond[places.at])[kept] | places.empty[kept]]
    return places.lists(kept, texts.is_null(), [], [])


def lexed(source: Column, language: Column, keep_space: bool, marked: bool = False) -> Column:
    """array of (pos, raw, start, line, col): a source's pieces by its language's total pattern with their places, an empty one at its end;
    null of a null source. Blanks are dropped after they have been counted, and of ``marked`` tokens all that are ASCII."""

    @F.arrow_udf(f"array<{_TOKEN}>")
    def placed(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return _placed(texts, languages, keep_space, marked)

    return placed(F.make_valid_utf8(source), language)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole sources small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def name_kind(raw: Column) -> Column:
    return F.when(has_vietnamese(raw) & raw.rlike("[A-Za-z_]"), "MixedIdentifier").when(has_vietnamese(raw), "VietnameseIdentifier").otherwise("Identifier")


def keyword_of(raw: Column, language: Column) -> Column:
    return (
        F.when(language.isin("JavaScript", "TypeScript"), raw.isin(C.KEYWORDS["JavaScript"]))
        .when(language.isin("C", "Cpp"), raw.isin(C.KEYWORDS["Cpp"]))
        .otherwise(raw.isin(C.KEYWORDS["Python"]))
    )


def token_kind(raw: Column, pos: Column, language: Column) -> Column:
    script, native = language.isin("JavaScript", "TypeScript"), language.isin("C", "Cpp")
    python = ~script & ~native
    marked = has_vietnamese(raw)
    first = F.ascii(raw)
    starts = lambda *signs: first.isin([ord(c) for c in signs])
    line_comment = F.when(python, starts("#")).otherwise(starts("/") & raw.startswith("//"))
    block = F.when(python, starts('"', "'") & (raw.startswith('"""') | raw.startswith("'''"))).otherwise(starts("/") & raw.startswith("/*"))
    letter = first.between(ord("a"), ord("z")) | first.between(ord("A"), ord("Z")) | (first == ord("_")) | (first >= 0x80)
    return (
        F.when(letter & ~(native & raw.startswith('R"')), F.when(~marked & keyword_of(raw, language), "Keyword").otherwise(name_kind(raw)))
        .when(python & (pos == 0) & starts("#"), F.when(F.instr(raw, "coding") > 0, "EncodingDecl").otherwise("Comment"))
        .when(line_comment, F.when(marked, "VietnameseComment").otherwise("Comment"))
        .when(block, F.when(marked, "VietnameseComment").otherwise("BlockComment"))
        .when(script & starts("`"), "TemplateLiteral")
        .when(starts('"', "'") | (native & raw.startswith('R"')), "StringLiteral")
        .when(raw == "\n", "Newline")
        .when(starts(*" \t\r\x0b\x0c"), "Whitespace")
        .when(first.between(ord("0"), ord("9")), "NumberLiteral")
        .when(python & starts("@"), "Decorator")
        .when(native & starts("#") & (F.length(raw) > 1), "Punctuation")
        .when(native, "Operator")
        .otherwise("Punctuation")
    )


def tokens(sources: DataFrame, keep_space: bool = False, end: bool = True, marked: bool = False) -> DataFrame:
    """(row, file, language, pos, kind, raw, start, end, line, col, has_vietnamese) of (file, source, language).

    Byte offsets from 0, lines and byte columns from 1; blanks are dropped after they have
    been counted (and with ``marked`` tokens that are ASCII, for rules.MARKED), an EndOfFile row closes each file; null sources are empty. Nothing is shuffled: places are summed where
    sources are read, and ``row`` numbers rows of sources (or is the caller's key, where sources have that column), so that files of equal or null name stay apart.
    """
    text = F.coalesce("source", F.lit(""))
    row = F.col("row") if "row" in sources.columns else F.monotonically_increasing_id()
    small_batches(sources.sparkSession)
    rows = sources.select(row.alias("row"), "file", "language", text.alias("_text"))  # before the explode, as rows are numbered here
    rows = rows.select("row", "file", "language", F.explode(lexed(F.col("_text"), F.col("language"), keep_space, marked)).alias("t")).select("row", "file", "language", "t.*")
    kind = F.when(F.col("raw") == "", "EndOfFile").otherwise(token_kind(F.col("raw"), F.col("pos"), F.col("language")))
    if not end:
        rows = rows.where("raw <> ''")
    return rows.select("row", "file", "language", "pos", kind.alias("kind"), "raw", "start", (F.col("start") + F.octet_length("raw")).alias("end"), "line", "col", has_vietnamese(F.col("raw")).alias("has_vietnamese"))
