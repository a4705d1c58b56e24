"""Runs of words that repeat with a period, by matching aligned blocks.

A run with period q, B/2 < q <= B = 2^k, and four periods or more holds a block of B words whose place is a multiple of B, and the same block
q words before or after. Between the two it does not occur: it is as long as the period, which is the run's least. So at each
scale the distinct aligned blocks are the keys of an automaton that reads the document, and occurrences of a key that follow each other at distances
of that scale are seeds, which are extended word by word in both directions.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone, arrow_rows, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words and so many periods at least.
LEAST, POWER = 6, 4
#: Symbols of a key at most: longer blocks are sequences of names of equal parts.
SYMBOLS = 64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, from some place on replaced by repeats of the first of them for one id of ten. A null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def numbered(words: list[str]) -> np.ndarray:
    named: dict[str, int] = {}
    return np.fromiter((named.setdefault(w, len(named)) for w in words), np.int64, len(words))


def frequent(x: np.ndarray, passes: int = 4) -> Iterator[tuple[int, np.ndarray]]:
    """(start, words) of stretches that every run lies in: each of its words occurs there POWER times or more, as it does in the run.

    Stretches are cut at rarer words, a few times over; more passes would only make them shorter.
    """
    todo = [(0, x, 0)]
    while todo:
        at, part, done = todo.pop()
        if len(part) < LEAST:
            continue
        if done == passes:
            yield at, part
            continue
        names, counts = np.unique(part, return_inverse=True, return_counts=True)[1:]
        rare = np.flatnonzero(counts[names] < POWER)
        if not len(rare):
            yield at, part
            continue
        starts, ends = np.concatenate([[0], rare + 1]), np.concatenate([rare, [len(part)]])
        for i in np.flatnonzero(ends - starts >= LEAST):
            todo.append((at + int(starts[i]), part[starts[i] : ends[i]], done + 1))


def seeds(x: np.ndarray, names: np.ndarray, block: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of occurrences of aligned blocks that recur at more than half a block and at most a block.

    names[i] tells the ``part`` words from i on; a block is a sequence of block / part names, and is searched in each of the ``part`` sequences of names
    that stand ``part`` words apart.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for s in range(0, len(x) - block + 1, block):
        automaton.add_word(tuple(names[s : s + block : part].tolist()), s)
    automaton.make_automaton()
    pair = np.dtype([("end", np.int64), ("key", np.int64)])
    places, keys = [], []
    for r in range(part):
        got = np.fromiter(automaton.iter(tuple(names[r::part].tolist())), pair)
        places.append((got["end"] - block // part + 1) * part + r)
        keys.append(got["key"])
    place, key = np.concatenate(places), np.concatenate(keys)
    order = np.lexsort((place, key))
    place, key = place[order], key[order]
    apart = np.diff(place)
    good = (key[1:] == key[:-1]) & (2 * apart > block) & (apart <= block)
    return place[:-1][good], apart[good]


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of a and b agree."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def is_least(x: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch with this period has no smaller one. A smaller one would divide it, as the stretch is of four periods."""
    rest, tried = period, set()
    for f in range(2, isqrt(period) + 1):
        if rest % f == 0:
            tried.add(f)
            while rest % f == 0:
                rest //= f
    if rest > 1:
        tried.add(rest)
    return not any(np.array_equal(x[start : start + period], x[start + p : start + p + period]) for p in (period // f for f in tried))


def stretch_runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch. Time grows with its length times the logarithm of it; an automaton holds as many symbols as the stretch at most."""
    n = len(x)
    if n >= LEAST:
        shared = np.unique(x, return_inverse=True)[1].astype(np.int64)
    block = part = 1
    names = shared if n >= LEAST else x
    while n >= LEAST and block // 2 + 1 <= n // POWER:
        if block // part > SYMBOLS:  # name pairs of parts
            wide = names[: len(names) - part] * (int(names.max()) + 1) + names[part:]
            names = np.unique(wide, return_inverse=True)[1].astype(np.int64)
            part *= 2
        place, apart = seeds(x, names, block, part)
        order = np.lexsort((place, apart))
        known, until = 0, -1  # the last stretch found for a distance
        for i, d in zip(place[order].tolist(), apart[order].tolist(), strict=True):
            if d == known and i < until:
                continue
            start = i - reach(x[:i][::-1], x[: i + d][::-1])
            end = i + d + reach(x[i:], x[i + d :])
            known, until = d, end - d
            if end - start >= max(LEAST, POWER * d) and is_least(x, start, d):
                yield start, end - start, d
        block *= 2


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period: stretches with least period q, LEAST words and POWER * q words or more, that no neighbouring word extends."""
    return sorted((at + start, length, period) for at, part in frequent(numbered(words)) for start, length, period in stretch_runs(part))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that stand in some run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def periodic_documents(docs: DataFrame, plant: bool = False, keep_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 (and runs, if asked for) of every whole text.

    start, length and period are the longest run's (ties: smallest start, then period), null without a run. plant: repeats are put into one document of ten first.
    Null texts are empty. One row a row in place, repeats and null ids included; no shuffle; other columns are not read; an empty table gives no rows.
    A task holds one document at a time, whatever its length, with what an automaton of it takes.
    """
    arrow_rows(docs.sparkSession)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("periodic")
        for batch, texts in blocks(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                if plant:
                    words = planted(words, doc_id)
                runs = runs_of(words)
                top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                power = 1000 * top[1] // top[2] if runs else None
                said = digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
                out.append((len(runs), *top, power, said, digest(" ".join(collapsed(words, runs))), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] if keep_runs else None))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(run)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
    made = docs.select("doc_id", "text").mapInArrow(found, schema)
    return made if keep_runs else made.drop("runs")
