"""What F11 asked for: all labelled rows count in op12's ranges and limit."""

import numpy as np

from tidewright.llm import quality


def test_all_labelled_rows_count(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 1.0, (6000, len(quality.STATISTICS)))
    x[::4] += 9 * rng.random((1500, 1))
    ids = [int(i) for i in rng.permutation(6000)]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(7000, None)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(k % 4 > 0)) for k, i in enumerate(ids)] + [(7000, 0), (8000, 1)], "doc_id long, quality int")
    model = quality.fit(rows.repartition(7), labels)
    good, bad = x[np.arange(6000) % 4 > 0], x[::4]
    ends = [np.quantile(good, q, axis=0, method="inverted_cdf") for q in (quality.UNUSUAL, 1 - quality.UNUSUAL)]
    assert np.allclose([model.low, model.high], ends, rtol=0.005)
    lost, found = ((model.scores(rows) > model.limit).sum() for rows in (good, bad))
    assert lost <= quality.LOST * len(good) and found > 0
    every = np.unique(model.scores(x))
    lower = every[every < model.limit].max()  # the next limit below loses too many, or finds no more
    assert (model.scores(good) >= lower).sum() > quality.LOST * len(good) or (model.scores(bad) >= lower).sum() == found
    again = quality.fit(rows.orderBy("doc_id").coalesce(1), labels)
    assert again.limit == model.limit and np.array_equal(again.high, model.high)
