"""Toxicity severity by cumulative-link ordinal regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, arrow_rows, blocks
from .textfeatures import WordScores, sample_features, sample_rows

#: Letter n-grams, their hashed dimensions, how many of them the model uses, and the most labelled rows of a class that the fit reads.
LEAST, MOST, DIMS, USED, SAMPLE = 3, 6, 1 << 16, 600, 1000
#: Grades beyond "not toxic".
GRADES = 3


def screened(sample: list, toxic: np.ndarray) -> np.ndarray:
    """The USED features that part toxic documents from others best, by the chi-square of being there."""
    there = np.zeros((2, DIMS))
    for (_, ix, _), t in zip(sample, toxic, strict=True):
        there[int(t), ix] += 1
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    rate = there / np.maximum(n[:, None], 1)
    pooled = there.sum(axis=0) / max(n.sum(), 1)
    chi = (rate[1] - rate[0]) ** 2 / (pooled * (1 - pooled) + 1e-3)
    return np.sort(np.argsort(-chi, kind="stable")[:USED])


def severity_grades(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic; toxic ones by thirds of their share of features that only toxic rows have.

    The labels say only whether a text is toxic; how much of it is gives their order.
    """
    own = (x[toxic] > 0).mean(axis=0) > 5 * (x[~toxic] > 0).mean(axis=0) + 0.01 if toxic.any() and (~toxic).any() else np.zeros(x.shape[1], bool)
    dose = x[:, own].sum(axis=1)
    grades = toxic.astype(int)
    if toxic.any():
        cuts = np.quantile(dose[toxic], [k / GRADES for k in range(1, GRADES)])
        grades[toxic] = 1 + np.searchsorted(cuts, dose[toxic], side="right")
    return grades


def cumulative_link(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rising thresholds): P(grade > k) = sigmoid(x @ weights - threshold[k]), weights shared by all k.

    Classes weigh alike; proximal descent with momentum on the summed threshold losses.
    """
    above = (y[:, None] > np.arange(GRADES)[None, :]).astype(float)
    weight = np.empty_like(above)
    for k in range(GRADES):
        share = np.clip([1 - above[:, k].mean(), above[:, k].mean()], 1e-9, 1)
        weight[:, k] = np.where(above[:, k] > 0, 0.5 / share[1], 0.5 / share[0]) / len(y)
    z = np.column_stack([x, np.ones(len(x))])
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (weight.sum(axis=1) * (z @ v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * top * 1.1 + ridge)
    w, cut = np.zeros(x.shape[1]), np.linspace(-0.5, 0.5, GRADES)
    aw, ac, t = w, cut, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ aw, -30, 30)[:, None] + ac[None, :]))
        miss = weight * (p - above)
        nw, nc = aw - rate * (x.T @ miss.sum(axis=1) + ridge * aw), np.maximum.accumulate(ac + rate * miss.sum(axis=0))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        aw, ac = nw + (t - 1) / after * (nw - w), nc + (t - 1) / after * (nc - cut)
        w, cut, t = nw, nc, after
    return w, np.maximum.accumulate(cut)


class Model:
    def __init__(self, sample: list):
        toxic = np.array([s[0] == 1 for s in sample], bool)
        self.weights, self.cuts = np.zeros((DIMS, 1), np.float32), np.full(GRADES, 30.0)
        if toxic.any() and not toxic.all():
            used = screened(sample, toxic)
            x = np.zeros((len(sample), USED))
            for row, (_, ix, n) in zip(x, sample, strict=True):
                if len(ix):
                    full = np.zeros(DIMS)
                    full[ix] = n / n.sum()
                    row[:] = full[used]
            scale = 1 / (x.std(axis=0).max() + 1e-12)
            w, self.cuts = cumulative_link(x * scale, severity_grades(x, toxic))
            self.weights[used, 0] = w * scale

    def grade(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k from rows of WordScores.sums; 0 without words."""
        n = sums[:, -1]
        score = sums[:, 0] / np.maximum(n, 1)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -30, 30)))
        return np.where(n[:, None] > 0, p, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled whole texts, ``sample`` of each class at most (the bound), least by a hash of the id."""
    named = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # only ids and labels are sorted out first; then the texts of those ids
    picked = sample_rows(named, "toxic", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return Model(sample_features(rows, "toxic", LEAST, MOST, DIMS))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, grade (most steps passed with even odds), toxic.

    Null, empty and letterless texts: 0 and not toxic, as is everything where both classes
    weren't there to learn from. A row a row, in place; no shuffle.
    """
    arrow_rows(docs.sparkSession)

    def scored(batches):
        alone("words")
        scores = WordScores(model.weights, LEAST, MOST)
        for batch, texts in blocks(batches):
            p = model.grade(scores.sums(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def toxicity_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """score_toxicity of docs by a model fitted on those that labels (doc_id, toxic) names (see fit).

    Labels that are null or name no document teach nothing; of several for one id the highest counts, and of rows that repeat an id the one
    with the least text teaches. Words of one or two letters have the n-grams that fit between their edges; one
    word of a letter may have none. Every row of docs is scored, repeats and null ids included; other columns are not read; an empty table
    gives no rows, and without labels of both classes all score 0.
    """
    return score_toxicity(docs, fit(docs, labels, sample))
