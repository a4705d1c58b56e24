"""Quality rules: fixed rules, and an isolation forest over their statistics."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, arrow_rows, blocks, settle

#: Words: runs without white space; symbols that are counted.
WORD, SYMBOLS = re.compile(r"[^\x20\x09-\x0D]+"), "#*$%&|<>"
#: The base rules: fewest words, words of a repeated window, and the share (of 100) of words in such windows that fails.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Statistics of a text that the forest splits on, in their order.
STATISTICS = ("words", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "marks", "letterless", "distinct")
#: Trees, rows of a tree, and the part of them that are labelled bad.
TREES, ROWS, BAD = 200, 256, 0.02
#: Significant digits of the values that usual ranges are read from, and decimals of a score.
DIGITS, DECIMALS = 3, 5
#: Part of the labelled good rows that lies outside a statistic's usual range, at either end, and that the threshold may reject.
UNUSUAL, LOST = 0.005, 0.002
#: A usual range is no narrower than this.
LEAST_WIDTH = 0.02

_KIND = np.array([(c.isupper() << 1) | c.isalpha() for c in map(chr, range(1 << 16))], np.uint8)


def repeated_words(numbers: np.ndarray) -> int:
    """Words within windows of WINDOW words that the text has twice or more. Windows are named by doubling, without hashes."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    names, size = numbers, 1
    while size < WINDOW:  # a name of 2 * size words is the pair of the names of its halves
        pairs = names[: len(names) - size] * (int(names.max()) + 1) + names[size:]
        names = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def base_rules(text: str | None) -> tuple[tuple[int, int, int, int, int], list[str], int]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), distinct words, lines with a word); null: as empty."""
    if not text:
        return (0, 0, 0, 0, 0), [], 0
    words = WORD.findall(text)
    named: dict[str, int] = {}
    numbers = np.fromiter((named.setdefault(w, len(named)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(map(text.count, SYMBOLS))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated_words(numbers)), list(named), len(lines)


def fails(base: tuple[int, int, int, int, int]) -> bool:
    return base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]


def statistics(text: str, base: tuple[int, int, int, int, int], distinct: list[str], lines: int) -> list[float]:
    """STATISTICS of a text with a word. Words without a letter and capitals are counted over the text's code points and distinct words."""
    n, chars, symbols, dup, repeated = base
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_KIND[points[points < 1 << 16]], minlength=4)
    letters = int(kinds[1] + kinds[3])
    bare = sum(not any(map(str.isalpha, w)) for w in distinct)
    return [math.log1p(n), chars / n, symbols / n, dup / lines, repeated / n, int(kinds[3]) / max(letters, 1), (text.count("!") + text.count("?")) / n, bare / len(distinct), len(distinct) / n**0.75]


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Steps to tell a row from n - 1 others, on average."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), 0.0) * (n > 1)


class Forest:
    """Trees over random splits, as arrays: the statistic and value of a node's split, its children, and what a path to it counts (leaves)."""

    def __init__(self, x: np.ndarray, bad: np.ndarray, trees: int = TREES, seed: int = 1):
        rng = np.random.default_rng(seed)
        good, other = np.flatnonzero(~bad), np.flatnonzero(bad)
        few = min(len(other), round(ROWS * BAD), max(1, round(len(good) * BAD)))
        self.size = min(len(good), ROWS - few) + few
        self.trees = []
        for _ in range(trees):
            pick = np.concatenate([rng.choice(good, self.size - few, replace=False), rng.choice(other, few, replace=False)]) if self.size else good
            self.trees.append(self._grown(x[pick], rng))

    def _grown(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # statistic (-1: a leaf), value, left, right, path
        todo = [(np.arange(len(x)), 0, -1, 0)]  # rows, depth, parent, side
        deepest = math.ceil(math.log2(max(len(x), 2)))
        while todo:
            rows, depth, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) <= 1 or not len(open_):
                nodes.append([-1, 0, 0, 0, depth + float(expected_path(len(rows)))])
                continue
            f = int(rng.choice(len(low), p=(high - low) / (high - low).sum()))  # wider statistics are split more often
            value = rng.uniform(low[f], high[f])
            under = x[rows, f] < value
            todo += [(rows[under], depth + 1, len(nodes), 0), (rows[~under], depth + 1, len(nodes), 1)]
            nodes.append([f, value, 0, 0, 0])
        table = np.array(nodes)
        return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly by row, 0 to 1: two to the mean path over the expected one, negative."""
        if not len(x) or self.size < 2:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                split = f[at]
                if (split < 0).all():
                    break
                inner = split >= 0
                down = np.where(x[rows, np.maximum(split, 0)] < value[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / float(expected_path(self.size)))


class Model:
    """Usual ranges of the statistics, a forest over how far labelled rows lie beyond them, and the score from which a text is rejected.

    Without rows of both labels nothing is rejected. Statistics within their range are alike to the forest, so that only what breaks
    some rule of the good rows is told apart from them, in few steps where few rows break it so far.
    """

    def __init__(self) -> None:
        self.forest, self.limit = None, math.inf

    def grow(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, bad: np.ndarray) -> None:
        """The forest of rows that trees are drawn from, within ranges of all good rows."""
        self.low, self.high, self.width = low, high, high - low + LEAST_WIDTH
        self.forest = Forest(self.beyond(x), bad)

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """How far statistics lie outside their usual range, in widths of it; below it counts negative."""
        return (np.maximum(x - self.high, 0) + np.minimum(x - self.low, 0)) / self.width

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly by row, to DECIMALS. Rows within all ranges are alike, and scored once."""
        if not self.forest:
            return np.zeros(len(x))
        beyond = self.beyond(x)
        out = beyond.any(axis=1)
        scores = np.full(len(x), self.forest.scores(np.zeros((1, len(STATISTICS))))[0])
        scores[out] = self.forest.scores(beyond[out])
        return np.round(scores, DECIMALS)


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Of the limits that reject LOST of the good rows at most, the one in the middle of the widest gap among those that find most bad rows.

    ``scores`` rise, each with how many good and bad rows have it. A limit lies between two scores that follow each other; what it rejects is above it.
    """
    limits = np.concatenate([(scores[:-1] + scores[1:]) / 2, [math.inf]])
    above = lambda n: n.sum() - np.cumsum(n)
    caught = np.where(above(good) <= LOST * good.sum(), above(bad), -1)
    gaps = np.concatenate([np.diff(scores), [0.0]])
    best = np.flatnonzero(caught == caught.max())
    return float(limits[best[np.argmax(gaps[best])]])


def usual(good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The UNUSUAL quantiles of each statistic over all rows of ``good``, at either end.

    Values count by their first DIGITS digits, some thousands of them whatever the number of rows; the driver gets how many rows have each.
    """
    power = F.when(F.col("v") > 0, F.floor(F.log10("v")) - (DIGITS - 1)).otherwise(0).cast("int")
    values = good.select(F.posexplode("x").alias("i", "v")).select("i", power.alias("e"), F.round(F.col("v") / F.pow(F.lit(10.0), power)).cast("int").alias("m"))
    counted = values.groupBy("i", "e", "m").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = []
    for i in range(len(STATISTICS)):
        v, n = map(np.array, zip(*sorted((float(f"{r['m']}e{r['e']}"), r["n"]) for r in counted if r["i"] == i), strict=True))
        upto = np.cumsum(n)
        ends.append([v[np.searchsorted(upto, q * upto[-1])] for q in (UNUSUAL, 1 - UNUSUAL)])
    low, high = np.array(ends).T
    return low, high


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Learn from all ``measured`` rows that labels (quality 0 or 1) name and the base rules pass.

    Every one of them counts in the usual ranges and in the limit. A tree has ROWS rows, as isolation forests do; they are drawn from as many rows of a
    class as all trees have together, those least by a hash of the id. Null labels teach nothing; of several for one id the lowest counts, and of rows
    that repeat an id the one with the least statistics teaches.
    """
    named = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taught = settle(rows.where("x is not null").select("doc_id", "x").join(named, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")))
    bad = (F.col("quality") == 0).alias("bad")
    n = {r["bad"]: r["count"] for r in taught.groupBy(bad).count().collect()}
    model = Model()
    if len(n) < 2:
        return model
    low, high = usual(taught.where("quality <> 0"))
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    share = F.when(bad, TREES * ROWS * BAD / n[True]).otherwise(TREES * ROWS / n[False]) * float(1 << 32)
    drawn = taught.where(h < share).select("doc_id", bad, "x").orderBy("doc_id").collect()
    is_bad = np.array([r["bad"] for r in drawn], bool)
    if not is_bad.any() or is_bad.all():
        return model
    model.grow(low, high, np.array([r["x"] for r in drawn]), is_bad)

    def scored(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(x)), batch.column("bad")], ["score", "bad"])

    told = taught.select("x", bad).mapInArrow(scored, "score double, bad boolean").groupBy("score").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    model.limit = threshold(*np.array([tuple(r) for r in told.orderBy("score").collect()]).T)
    return model


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTS = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, what the base rules count and say, and x, the statistics of every whole text (null where the base rules fail).

    Null texts are empty and fail. One row a row in place, repeats and null ids included; no shuffle; other columns are not read; very long texts are read whole.
    """
    arrow_rows(docs.sparkSession)

    def told(batches):
        alone("quality")
        for batch, texts in blocks(batches):
            found = [base_rules(t) for t in texts]
            failed = [fails(f[0]) for f in found]
            x = [None if no else statistics(t, *f) for t, f, no in zip(texts, found, failed, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array([f[0][i] for f in found], pa.int64()) for i in range(5)), pa.array(failed, pa.bool_()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *NAMES, "base_failed", "x"])

    return docs.select("doc_id", "text").mapInArrow(told, f"{_COUNTS}, x array<double>")


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly of ``measured`` rows.

    kept: the base rules pass and the forest finds the text no more anomalous than its limit; anomaly is null where the base rules fail.
    """

    def rated(batches):
        for batch in batches:
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").drop_null().to_pylist()).reshape(-1, len(STATISTICS))
            scores, rejected = np.full(len(failed), np.nan), failed.copy()
            if len(x) and model.forest:
                scores[~failed] = model.scores(x)
                rejected[~failed] = scores[~failed] > model.limit
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(~rejected), pa.array(scores, pa.float64(), from_pandas=True)], [*batch.schema.names[:-1], "kept", "anomaly"])

    return rows.mapInArrow(rated, f"{_COUNTS}, kept boolean, anomaly double")


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judged docs by a model fitted on those that labels (doc_id, quality) names; see fit. Each text is read and measured once. An empty table gives no
    rows, and without labels of both classes the base rules alone decide."""
    rows = settle(measured(docs))
    return judged(rows, fit(rows, labels))
