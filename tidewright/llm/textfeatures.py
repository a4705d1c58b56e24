"""Hashed letter n-grams of words, and linear scores summed over words, for the classifiers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, arrow_rows, blocks

#: Letters with the letters and marks that follow; marks that follow no letter are no word.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words that a worker remembers, and the longest that it remembers.
MEMORY_WORDS, MEMORY_CHARS = 150_000, 32


def grams(words: list[str], least: int, most: int, dims: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(where each word starts, [(feature, is there) by n]): hashed n-grams, n from least to most, of the words between their
    edges, side by side, one at each letter if it lies within its word."""
    edged = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, edged), np.int64, len(edged))
    points = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # letters from here to the word's end
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, most + 1):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        m = max(0, len(points) - n + 1)  # few short words have fewer letters than n
        h[:m] += points[n - 1 : n - 1 + m]
        if n >= least:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append((((mixed >> np.uint64(33)) % np.uint64(dims)).astype(np.int64), left >= n))
    return ends - sizes, out


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def gram_counts(text: str | None, least: int, most: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) over a whole text."""
    counted = Counter(words_of(text))
    if not counted:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    starts, found = grams(list(counted), least, most, dims)
    times = np.repeat(np.fromiter(counted.values(), np.float64, len(counted)), np.diff([*starts, len(found[0][0])]))
    every = np.bincount(np.concatenate([g[there] for g, there in found]), weights=np.concatenate([times[there] for _, there in found]), minlength=dims)
    ix = np.flatnonzero(every)
    return ix.astype(np.uint32), every[ix].astype(np.float32)


def sample_rows(docs: DataFrame, label: str, most: int, total: int = 1 << 30) -> DataFrame:
    """The labelled rows to fit on: of each label, ``most`` at most (fewer where all labels together would pass ``total``),
    those least by a hash of the id. No label is left out.

    docs has doc_id, text and the label. Ids and labels alone are read for it, twice: labels are counted, and of each the rows
    whose hash is below a share that holds twice as many as asked are ranked; so no task meets all rows of a label, and the
    driver sees the ids of the sample.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    counts = named.groupBy("label").agg(((2 * most + 10) / F.count(F.lit(1)) * float(1 << 32)).alias("share"))
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    near = named.withColumn("h", h).join(F.broadcast(counts), "label").where("h <= share")  # a row a label, of which the driver gets ids anyway
    ranked = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("doc_id", "label", "n").collect()
    fair = max(2, min(most, total // max(1, len({r["label"] for r in ranked}))))
    picked = [r["doc_id"] for r in ranked if r["n"] <= fair]
    if not picked:
        return docs.limit(0)
    ids = spark.createDataFrame([(i,) for i in sorted(set(picked))], "doc_id long")
    return docs.where(F.col(label).isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")


def sample_features(rows: DataFrame, label: str, least: int, most: int, dims: int) -> list:
    """[(label, sparse counts)] of a bounded sample, sorted by id; texts stay on the executors, and the driver gets packed arrays."""
    arrow_rows(rows.sparkSession)
    kind = rows.schema[label].dataType.simpleString()

    def counted(batches):
        alone("features")
        for batch, texts in blocks(batches):
            feats = [gram_counts(t, least, most, dims) for t in texts]
            ix, n = ([f[i].tobytes() for f in feats] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(label), pa.array(ix, pa.binary()), pa.array(n, pa.binary())], ["doc_id", label, "ix", "n"])

    got = rows.select("doc_id", label, "text").mapInArrow(counted, f"doc_id long, {label} {kind}, ix binary, n binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i, ids=got.column("doc_id").to_pylist(): ids[i])
    labels, ix, n = (got.column(c) for c in (label, "ix", "n"))
    return [(labels[i].as_py(), np.frombuffer(ix[i].as_buffer(), np.uint32), np.frombuffer(n[i].as_buffer(), np.float32)) for i in order]


def dense(sample: list, dims: int) -> np.ndarray:
    """Rows of relative frequencies."""
    x = np.zeros((len(sample), dims), np.float32)
    for row, (_, ix, n) in zip(x, sample, strict=True):
        if len(ix):
            row[ix] = n / n.sum()
    return x


class WordScores:
    """Sums over a text's words of the linear weights (dims x outputs) of their n-grams; the last output counts them."""

    def __init__(self, weights: np.ndarray, least: int, most: int):
        self.weights, self.least, self.most = np.ascontiguousarray(weights, np.float32), least, most
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, weights.shape[1] + 1), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        starts, found = grams(words, self.least, self.most, len(self.weights))
        sums = np.zeros((len(found[0][0]), self.table.shape[1]), np.float32)
        for g, there in found:
            sums[there, :-1] += self.weights[g[there]]
            sums[there, -1] += 1
        return np.add.reduceat(sums, starts, axis=0)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """A row a text."""
        out = np.zeros((len(texts), self.table.shape[1]), np.float64)
        found = [words_of(t) for t in texts]
        if len(self.index) > MEMORY_WORDS:
            self.index.clear()
        new = [w for w in set().union(*found) - self.index.keys()]
        long = {w: None for w in new if len(w) > MEMORY_CHARS}
        new = [w for w in new if w not in long]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at = len(self.index)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part)] = self._rows(part)
            self.index.update(zip(part, range(at, at + len(part)), strict=True))
        for w in long:
            long[w] = self._rows([w])[0]
        for row, words in zip(out, found, strict=True):
            if words:
                if long:
                    row += sum((long[w] for w in words if w in long), np.zeros(len(row)))
                    words = [w for w in words if w not in long]
                row += self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out
