"""Fill-in-the-middle transformation: cuts found by a parallel scan of an automaton.

The automaton reads code points and has two states, in a word or not; it counts the ends of words. A chunk of text is a
function from the state that enters it to the state that leaves it, with the ends it counts from each; functions
compose associatively, so that chunks are read apart, in any order, and the states that enter them are resolved after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, arrow_rows, blocks, fresh, settle

#: Code points of a chunk; texts of more than GIANT code points are dealt to tasks chunk by chunk.
CHUNK, GIANT = 1 << 16, 1 << 20
#: Giant texts whose cuts are broadcast at most, at some 100 bytes each; more are joined by a shuffle of the giant texts.
BROADCAST_ROWS = 100_000
#: The seed, the sentinels, and the shares (of 100) of transformed documents and of those that begin with the suffix.
SEED, PREFIX, SUFFIX, MIDDLE, RATE, SPM_RATE = 42, "<P>", "<S>", "<M>", 50, 80


class Chunk(NamedTuple):
    """What a chunk does to the automaton: by the state before it (0: not in a word, 1: in one), the state after it and the words that end in it."""

    after0: int
    after1: int
    ends0: int
    ends1: int


NOTHING = Chunk(0, 1, 0, 0)


def spaces(text: str) -> np.ndarray:
    """By code point: whether it is white space (x20, x09 to x0D)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (points == 0x20) | (points - np.uint32(9) < 5)


def scanned(text: str) -> Chunk:
    """The function of a chunk."""
    if not text:
        return NOTHING
    space = spaces(text)
    ends = int(np.count_nonzero(space[1:] > space[:-1]))
    after = int(not space[-1])
    return Chunk(after, after, ends, ends + int(space[0]))


def composed(f: Chunk, g: Chunk) -> Chunk:
    """f, then g."""
    (a0, e0), (a1, e1) = ((g.after1, g.ends1) if f.after0 else (g.after0, g.ends0)), ((g.after1, g.ends1) if f.after1 else (g.after0, g.ends0))
    return Chunk(a0, a1, f.ends0 + e0, f.ends1 + e1)


def units(whole: Chunk, empty: bool) -> int:
    """Tokens of a text: each ends where a word ends, the last one where the text does."""
    return 0 if empty else whole.ends0 + 1


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers from the id; a null id counts as the word null."""
    digest = hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def chosen(doc_id: int | None, n: int) -> tuple[int, int]:
    """Units before the first and before the second cut."""
    h1, h2, _, _ = draws(doc_id)
    return tuple(sorted((h1 % (n + 1), h2 % (n + 1))))


def located(prefixes: list[Chunk], unit: int, n: int) -> tuple[int, int, int] | None:
    """(chunk, state before it, end within it from 1) of the cut after ``unit`` units; None at the text's end. prefixes[i] composes the chunks before i."""
    if not unit:
        return 0, 0, 0
    if unit == n:
        return None
    ends = [p.ends0 for p in prefixes]
    i = int(np.searchsorted(ends, unit, "left")) - 1
    return i, prefixes[i].after0, unit - ends[i]


def placed(text: str, state: int, rank: int) -> int:
    """Where in a chunk its rank-th word ends, if ``state`` enters it; rank 0: at its start."""
    if not rank:
        return 0
    space = spaces(text)
    ends = np.flatnonzero(space & ~np.concatenate([[not state], space[:-1]]))
    return int(ends[rank - 1])


def cut_places(text: str, found: list[tuple[int, int, int] | None], chunk: int) -> list[int]:
    """Code points before each cut."""
    return [len(text) if f is None else f[0] * chunk + placed(text[f[0] * chunk : (f[0] + 1) * chunk], f[1], f[2]) for f in found]


def cuts(doc_id: int | None, text: str, chunk: int = CHUNK) -> tuple[int, list[int]]:
    """(n, code points before either cut) of a text in hand."""
    parts = [scanned(text[i : i + chunk]) for i in range(0, len(text), chunk)]
    prefixes = list(accumulate(parts, composed, initial=NOTHING))
    n = units(prefixes[-1], not text)
    return n, cut_places(text, [located(prefixes, u, n) for u in chosen(doc_id, n)], chunk) if n else [0, 0]


def form_of(doc_id: int | None, text: str) -> str:
    _, _, h3, h4 = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= RATE:
        return "plain"
    return "spm" if h4 % 100 < SPM_RATE else "psm"


def transformed(text: str, form: str, first: int, second: int) -> str:
    """The output: first and second are the code points before the cuts."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of. Texts of outputs hold no sentinel, and no sentinel can begin within one."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = output.index(two, len(one))
    b = output.index(MIDDLE, a)
    x, y, middle = output[len(one) : a], output[a + len(two) : b], output[b + len(MIDDLE) :]
    return x + middle + y if form == "psm" else y + middle + x


def giant_cuts(docs: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """(key, n, first, second): of every giant text its units and where its cuts lie (chunk, state before, rank; null: at the end).

    Chunks of all giant texts are dealt to tasks, wherever their text came from, and become functions; a text's functions (``chunk`` code
    points each, so a bounded number) are composed, and the chunks that hold the cuts are selected. Equal rows send equal chunks, of which one counts.
    """
    place = "struct<chunk: int, state: int, rank: long>"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            for k, doc_id, text in zip(batch.column(key).to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                for at in range(0, len(text), 16 * chunk):
                    parts = [text[i : i + chunk] for i in range(at, min(at + 16 * chunk, len(text)), chunk)]
                    numbers = range(at // chunk, at // chunk + len(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts)), pa.array([doc_id] * len(parts), pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], ["key", "doc_id", "no", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("fim")
        for batch, texts in blocks(batches):
            found = [scanned(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "no")), *(pa.array([f[i] for f in found], pa.int64()) for i in range(4))], ["key", "doc_id", "no", *Chunk._fields])

    def selected(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("no", *Chunk._fields)), strict=True))
        prefixes = list(accumulate((Chunk(*r[1:]) for r in rows), composed, initial=NOTHING))
        n = units(prefixes[-1], not rows)
        found = [located(prefixes, u, n) for u in chosen(table.column("doc_id")[0].as_py(), n)]
        kind = pa.struct([("chunk", pa.int32()), ("state", pa.int32()), ("rank", pa.int64())])
        at = [pa.array([None if f is None else dict(zip(("chunk", "state", "rank"), f, strict=True))], kind) for f in found]
        return pa.table([table.column("key")[:1], pa.array([n], pa.int64()), *at], ["key", "n", "first", "second"])

    chunks = docs.select("doc_id", key, "text").mapInArrow(dealt, "key string, doc_id long, no int, text string").repartition("key", "no")
    summed = chunks.mapInArrow(read, "key string, doc_id long, no int, " + ", ".join(f"{f} long" for f in Chunk._fields))
    once = summed.groupBy("key", "no").agg(*(F.first(c).alias(c) for c in ("doc_id", *Chunk._fields)))
    return once.groupBy("key").applyInArrow(selected, f"key string, n long, first {place}, second {place}")


def fill_in_middle(docs: DataFrame, keep_output: bool = False, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (and the output, if asked for) of every whole text.

    A text is cut into tokens (white space and the word behind it; white space at the end), and at two of their ends, drawn from a hash of
    the id, into prefix, middle and suffix. Null texts are empty; empty texts, those that hold a sentinel and half of all others are plain,
    with null prefix_chars and middle_chars. A null id draws as the word null. One row a row, repeats included; other columns are not read; an empty table
    gives no rows. Texts up to ``giant`` code points are cut where they are; of longer ones only the chunks are shuffled, once. Their output and its
    hash are made in one task a document, as a hash follows the whole output.
    """
    arrow_rows(docs.sparkSession)
    key = fresh("_giant", docs.columns)
    long = F.length("text") > giant
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.col("text").cast("binary"), 256))
    rows = docs.select("doc_id", "text")
    found = settle(giant_cuts(rows.where(long).withColumn(key, name), key, chunk))
    n = found.count()
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("n", "first", "second")]
    if not n:
        ready = rows.select("doc_id", "text", *nothing)
    elif n <= BROADCAST_ROWS:
        ready = rows.withColumn("key", F.when(long, name)).join(F.broadcast(found), "key", "left").drop("key")
    else:
        ready = rows.where(long).withColumn("key", name).join(found, "key").drop("key").unionByName(rows.where(~long | F.col("text").isNull()).select("doc_id", "text", *nothing))

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("fim")
        for batch, texts in blocks(batches):
            out = []
            for doc_id, text, n, first, second in zip(batch.column("doc_id").to_pylist(), texts, *(batch.column(c).to_pylist() for c in ("n", "first", "second")), strict=True):
                text = text or ""
                if n is None:
                    n, (a, b) = cuts(doc_id, text, chunk)
                else:
                    a, b = cut_places(text, [f and (f["chunk"], f["state"], f["rank"]) for f in (first, second)], chunk)
                form = form_of(doc_id, text)
                output = transformed(text, form, a, b)
                plain = form == "plain"
                out.append((n, form, None if plain else a, None if plain else b - a, digest(output), digest(restored(output, form)), output if keep_output else None))
            columns = [batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
    made = ready.select("doc_id", "text", "n", "first", "second").mapInArrow(cut, schema)
    return made if keep_output else made.drop("output")
