"""Rows that equal each other: no task holds them all; and what they mean for ranks, mixes and vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, embed, mixing, packing, sharding


def spread(df):
    """The largest share of df's rows in one partition."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def many(spark):
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    return same.unionByName(spark.range(500).select("id", F.concat(F.lit("text "), F.col("id").cast("string"))).toDF("doc_id", "text"))


def test_equal_rows_are_sharded_apart(spark, many, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 512)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sharding.shard_documents(many, 8)
        assert spread(out) < 0.5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = out.collect()
    assert len(got) == 30_500
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in per.values())


def test_equal_rows_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 100)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    got = packing.pack(same).collect()
    used = Counter()
    seats = set()
    for r in got:
        used[r["sequence_id"]] += r["length"]
        seats.update((r["sequence_id"], r["offset"] + i) for i in range(r["length"]))
    total = sum(r["length"] for r in got)
    assert len(got) == 3000 and len(seats) == total and max(used.values()) <= 4096
    assert all((s, i) in seats for s, n in used.items() for i in (0, n - 1))


def test_ranks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 3)
    rows = spark.createDataFrame([("a", 1)] * 10 + [("a", 2)] * 1 + [("b", None)] * 4 + [("a", 3)] * 7, "k string, v int")
    got = common.gapless_rank(rows, "k", F.coalesce(F.col("v"), F.lit(0)), ["v"], "rank").collect()
    assert Counter((r["k"], r["v"]) for r in got) == Counter({("a", 1): 10, ("a", 2): 1, ("b", None): 4, ("a", 3): 7})
    assert [r["v"] for r in sorted(got, key=lambda r: r["rank"]) if r["k"] == "a"] == [1] * 10 + [2] + [3] * 7
    assert sorted(r["rank"] for r in got if r["k"] == "a") == list(range(18)) and sorted(r["rank"] for r in got if r["k"] == "b") == [0, 1, 2, 3]


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    """A source without ids is cut within, near its target, and alike on reruns and as documents."""
    rows = [(None, f"a b c {i}", "s") for i in range(300)] + [(i, "x y z w " * 5, "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    mine = [r for r in got if r["source"] == "s"]
    taken = sum(r["taken"] for r in mine)
    assert abs(taken - mine[0]["target"]) <= 4 and 1 < len({r["copies"] for r in got} | {r["copies"] for r in mine})
    assert mixing.mixed_documents(docs).where("source = 's'").count() * 4 == taken
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_vectors(spark, monkeypatch):
    """Copies of a vector, more and fewer than make it hot, and columns with names that are used inside."""
    rows = [(i, [1.0, 0.0, 0.1], "a") for i in range(40)] + [(100 + i, [1.0, 0.01 * i, 0.1], "a") for i in range(3)] + [(200, [1.0, 0.0, 0.1], "b"), (201, None, "a"), (0, [1.0, 0.0, 0.1], "a")]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label string, n long, copies long, rid string")
    found = []
    for hot in (1, 2, 1024):
        monkeypatch.setattr(embed, "HOT", hot)
        found.append(sorted(map(tuple, embed.near_vectors(table).collect()), key=str))
    assert found[0] == found[1] == found[2]
    got = {r[0]: r for r in found[0]}
    assert got[5][1:] == (43, 0, False) and got[200][1:] == (0, 200, True) and got[201][1:] == (0, 201, True) and len(found[0]) == len(rows)


def test_places_among_bounds(spark):
    from tidewright.llm import winnow

    values = [-5, 0, 1, 2, 7, 8, 50, 99, 100, 101, None]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for bounds in ([], [1], [0, 7], list(range(0, 100, 3)), list(range(101))):
        got = [r["n"] for r in rows.select(winnow.below(F.col("v"), bounds).alias("n")).collect()]
        assert [n for n, v in zip(got, values, strict=True) if v is not None] == [sum(b < v for b in bounds) for v in values if v is not None]


def test_wide_vectors_are_dealt_in_parts(spark):
    import numpy as np

    assert [len(p) for p in embed._bounded(np.arange(10_000), 64)] == [8192, 1808] and max(map(len, embed._bounded(np.arange(1000), 4096))) * 4096 * 8 << embed.GRID <= embed.DEALT_BYTES
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=1500) if i % 3 else np.ones(1500) + 0.01 * rng.normal(size=1500)).tolist(), "a") for i in range(60)]
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {i: 19 if i % 3 == 0 else 0 for i in range(60)}
