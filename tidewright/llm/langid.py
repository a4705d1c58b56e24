"""Language identification: the family first, then pairwise linear machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, arrow_rows, blocks, fresh
from .textfeatures import WordScores, dense, sample_features, sample_rows

#: Languages by family. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn ur pa mr gu ne si",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he am mt",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
#: Letter n-grams, their hashed dimensions, and the most rows of a language that the fit reads.
LEAST, MOST, DIMS, SAMPLE = 1, 3, 4096, 300
#: Rows of all languages together that the fit reads at most: with many languages each gives fewer, two at least.
TOTAL = 4000


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear machine with squared hinge loss, classes weighted alike, by accelerated descent."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    v = np.ones(x1.shape[1]) / x1.shape[1] ** 0.5
    for _ in range(20):
        v = x1.T @ (weight * (x1 @ v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (2 * top * 1.1 + 1e-3)
    w, ahead, t = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - rate * (1e-3 * ahead - 2 * (x1.T @ (weight * slack * y)))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


class Model:
    """Weights (dims x machines) and what each machine tells apart."""

    def __init__(self, sample: list):
        self.languages = sorted({s[0] for s in sample})
        self.family = {c: FAMILY.get(c, c) for c in self.languages}
        self.families = sorted(set(self.family.values()))
        x, labels = dense(sample, DIMS), np.array([s[0] for s in sample], dtype=object)
        mean = x.mean(axis=0) if len(x) else np.zeros(DIMS)
        scale = 1 / (x.std(axis=0) + 1e-4) / DIMS**0.5 if len(x) else np.ones(DIMS)
        z = (x - mean) * scale
        self.machines: list[tuple[str, str, str]] = []
        columns, self.bias = [], []
        of = np.array([self.family[c] for c in labels], dtype=object)

        def fit(kind: str, a: str, b: str, keep, positive) -> None:
            w, bias = svm(z[keep], np.where(positive[keep], 1.0, -1.0))
            columns.append(w * scale)
            self.bias.append(bias - float((w * scale) @ mean))
            self.machines.append((kind, a, b))

        if len(self.families) > 1:
            for f in self.families:
                fit("family", f, "", np.ones(len(z), bool), of == f)
        for f in self.families:
            for a, b in combinations([c for c in self.languages if self.family[c] == f], 2):
                fit("pair", a, b, (labels == a) | (labels == b), labels == a)
        self.weights = np.array(columns, np.float32).T if columns else np.zeros((DIMS, 0), np.float32)

    def decide(self, sums: np.ndarray) -> tuple[list[str], list[float]]:
        """(language, score) of rows of WordScores.sums; without words: unknown, 0."""
        n = sums[:, -1:]
        margins = sums[:, :-1] / np.maximum(n, 1) + np.array(self.bias)[None, :]
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -8, 8)))
        languages, scores = [], []
        for row, p, count in zip(margins, sure, n[:, 0], strict=True):
            if not count or not self.languages:
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            tops = {a: (row[i], p[i]) for i, (kind, a, _) in enumerate(self.machines) if kind == "family"}
            family = max(tops, key=lambda f: (tops[f][0], f)) if tops else self.families[0]
            score = tops[family][1] if tops else 1.0
            mine = [c for c in self.languages if self.family[c] == family]
            votes, trust = dict.fromkeys(mine, 0), dict.fromkeys(mine, 1.0)
            for i, (kind, a, b) in enumerate(self.machines):
                if kind == "pair" and a in votes:
                    votes[a if row[i] >= 0 else b] += 1
                    trust[a] = min(trust[a], p[i])
                    trust[b] = min(trust[b], 1 - p[i])
            best = max(mine, key=lambda c: (votes[c], trust[c], c))
            languages.append(best)
            scores.append(float(min(score, trust[best])))
        return languages, scores


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """Learn from text and lang of rows that are not held out: ``sample`` whole texts a language and ``total`` in all at
    most (the bounds; every language has two or more, as many as it has rows), those least by a hash of their id."""
    rows = sample_rows(docs.where(~held_out()).select("doc_id", "text", "lang"), "lang", sample, total)
    return Model(sample_features(rows, "lang", LEAST, MOST, DIMS))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs (doc_id if None), and the language and its score under ``names`` (which keep
    must not hold), from the whole text alone.

    Texts that are null or have no letter (digits, signs and marks alone) are 'und' with score 0, as is all when nothing
    was learned. Very long texts are read whole, a block at a time. A row a row, in place, repeats and null ids included; an empty table gives no rows; no shuffle; the model is a few hundred KB.
    """
    arrow_rows(docs.sparkSession)
    keep = keep or ["doc_id"]
    column = fresh("_text", keep)
    ask = docs.select(*keep, F.col("text").alias(column))

    def told(batches):
        alone("words")
        scores = WordScores(model.weights, LEAST, MOST)
        for batch, texts in blocks(batches, column):
            languages, sure = model.decide(scores.sums(texts))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(languages, pa.string()), pa.array(sure, pa.float64())], [*keep, *names])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return ask.mapInArrow(told, schema)


def identify_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model fitted on them (see fit and identify); other columns are not read."""
    out = identify(docs.select("doc_id", "text"), fit(docs, sample))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
