"""Every operator and stage on nulls, ties, repeats, empty tables, clashing names and very long texts; op1 against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import common, embed, langid, minhash, mixing, packing, secrets, sharding, textfeatures, tokens, toxicity, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 30), ("en", "de")[i % 2], None if i % 3 else "s") for i in range(12)]
    rows += [(20, None, "en", "s"), (21, "", None, None), (22, words(rng, 30_000), "en", "s"), (23, "x" * 100_000, "de", "s"), (None, None, None, None), (None, "no id here", "en", "s"), (0, rows[0][1], "en", "s"), (1, "other text under one id", "de", "s")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows], SCHEMA)


def clashing(df):
    """With columns that operators use themselves."""
    extra = "score lang_pred _text _key key bands h size copies whole cut id rep class_id rank label _g _words".split()
    return df.select("*", *[F.lit(7).alias(c) for c in extra])


def test_stages_keep_their_columns(spark, odd):
    table = clashing(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, None)
        n, none = out.count(), stage(spark, table.limit(0), None)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert n >= table.count()
        else:
            assert out.columns == table.columns and out.where("score <> 7").count() == 0
        if name == "language":
            assert sorted(r["doc_id"] is None for r in out.collect()) == [False] * 16 + [True]
        if name == "near_dedup":
            assert n == odd.count() - 1 and out.where("doc_id = 1").count() == 2


def test_queries_on_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (99, 1)], "doc_id long, toxic int")
    run = {
        "op1": minhash.near_duplicates, "op2": lambda d: sharding.shard_documents(d, 8), "op3": lambda d: toxicity.toxicity_documents(d, labels), "op4": langid.identify_documents, "op5": tokens.count_tokens,
        "op6": mixing.mix, "op7": packing.pack, "op8": winnow.fingerprint_documents, "op10": secrets.scan_documents,
    }
    for name, f in run.items():
        assert f(odd.limit(0)).count() == 0, name
        got = f(clashing(odd)).collect()
        assert len(got) >= odd.count() if name == "op7" else len(got) == odd.count(), name
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label string")
    assert embed.near_vectors(none).count() == 0


def test_same_id_with_other_text(spark):
    rng = random.Random(2)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(1, a), (1, b), (2, a), (3, b + " tail"), (3, b + " tail"), (4, None), (4, a)]
    got = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in got)) == sorted([(1, a), (1, b), (4, "")])


def test_near_duplicates_against_all_pairs(spark):
    """Classes by weighted Jaccard of all pairs, with weights that differ; candidates are probabilistic, so pairs near 0.8 may be missed."""
    rng = random.Random(6)
    license_ = words(rng, 60)
    rows = []
    for _ in range(60):
        text = words(rng, 120).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(120)] = "changed"
            rows.append(" ".join(copy) + (" " + license_ if len(rows) % 2 else ""))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(1)
    # weights of the test's own: exact counts of classes, where the engine's table has estimates
    sets = [Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in rows]
    of = [minhash.class_of(minhash.shingles(minhash.words_of(t))[0]) for t in rows]
    df = Counter(g for _, g in {(c, g) for c, x in zip(of, sets, strict=True) for g in x})
    idf = {g: 1 if n <= 2 else min(1, math.log(1 + len(set(of)) / n) / math.log(33)) for g, n in df.items()}
    assert sum(x < 0.7 for x in idf.values()) >= 50  # the license weighs less
    vectors = [(list(x), [(1 + math.log(n)) * idf[g] for g, n in x.items()]) for x in sets]
    root, loose = list(range(len(rows))), list(range(len(rows)))  # loose: idf is of estimated counts, so a link may lie a little below 0.8 of exact ones
    sure = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = dict(zip(*vectors[i], strict=True)), dict(zip(*vectors[j], strict=True))
            low, high = sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys()), sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
            for least, of in ((0.8, root), (0.78, loose)):
                if low >= least * high:
                    x, y = of[i], of[j]
                    of[:] = [min(x, y) if r in (x, y) else r for r in of]
            if low >= 0.88 * high:
                sure.append((i, j))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert all(loose[i] == loose[got[i]] for i in got) and all(got[i] == got[j] for i, j in sure)
    assert sum(got[i] == root[i] for i in got) >= 0.98 * len(rows) and len(set(root)) < len(rows) - 15


def test_weights_do_not_depend_on_where_rows_lie(spark):
    """The same idf and classes of one task, of many, and of shuffled and repeated rows; counts near the exact ones."""
    rng = random.Random(8)
    license_, header = words(rng, 40), words(rng, 20)
    rows = [(i, (license_ + " " if i % 2 else "") + words(rng, 80) + (" " + header if i % 8 == 0 else "")) for i in range(1200)]
    rows += [(2000 + i, rows[i % 7][1] + f" edit{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = minhash.common_shingles(docs.repartition(1))
    for other in (docs.repartition(150, "doc_id"), docs.union(docs).repartition(9)):
        many = minhash.common_shingles(other)
        assert many.classes == one.classes and (many.idf == one.idf).all()
    of = [minhash.class_of(minhash.shingles(minhash.words_of(t))[0]) for _, t in rows]
    n = len(set(of))
    assert abs(one.classes / n - 1) < 0.05
    weigh = lambda text: one(*minhash.shingles(minhash.words_of(text)))
    expected = [math.log(1 + n / len({c for c, (_, t) in zip(of, rows, strict=True) if part in t})) / math.log(33) for part in (license_, header)]
    assert all(abs(weigh(t) - x).max() < 0.07 for t, x in zip((license_, header), expected, strict=True))
    own = rows[500][1].split()
    assert weigh(" ".join(own[:80])).min() == 1  # neither text of few documents nor text of many copies
    assert weigh(rows[2][1]).min() > 0.9
    near = [sorted(map(tuple, minhash.near_duplicates(docs.repartition(n)).collect())) for n in (1, 40)]
    assert near[0] == near[1]


def test_torn_rows_are_compared_exactly():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [words(rng, 100).split() for _ in range(4)]
    texts.append([*texts[0][:-3], "a", "b", "c"])
    vectors = [minhash.shingles(t) for t in texts]
    table = pa.table(
        {
            "id": [bytes([i]) for i in range(5)], "component": [bytes([i]) for i in range(5)], "left": [True] * 5, "right": [True] * 5,
            "h": [h.tobytes() for h, _ in vectors], "w": [b""] * 5,
        }
    )
    got = minhash.torn_links(table).to_pydict()
    assert {frozenset(x) for x in zip(got["a"], got["b"], strict=True)} == {frozenset((bytes([0]), bytes([4])))}
    exact = minhash.similarity(*[(h, n.astype(float)) for h, n in (vectors[0], vectors[4])])
    most = minhash.shared_at_most([(vectors[0][0], vectors[0][1].astype(float))], [(vectors[4][0], vectors[4][1].astype(float))])[0, 0]
    assert math.isclose(most, exact / (1 + exact) * sum(n.sum() for _, n in (vectors[0], vectors[4])), rel_tol=1e-3)


def test_every_language_is_learned(spark):
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = textfeatures.sample_rows(docs, "lang", 300, 1200).groupBy("lang").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {4}
    assert textfeatures.sample_rows(docs, "lang", 3).groupBy("lang").count().where("count <> 3").count() == 0


def test_many_shards(spark):
    ids = spark.range(300)
    spread = [r["s"] for r in ids.select(sharding.jump_shard(F.col("id"), 5000).alias("s")).collect()]
    more = [r["s"] for r in ids.select(sharding.jump_shard(F.col("id"), 5001).alias("s")).collect()]
    assert all(0 <= s < 5000 for s in spread) and all(m in (s, 5000) for s, m in zip(spread, more, strict=True))
    with pytest.MonkeyPatch.context() as patch:  # few jumps at once: the rest goes on, to the same shards
        patch.setattr(sharding, "JUMPS", 2)
        assert [r["s"] for r in ids.select(sharding.jump_shard(F.col("id"), 300).alias("s")).collect()] == [r["s"] for r in _at(ids, 300)]


def _at(ids, shards):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sharding, "JUMPS", 400)
        return ids.select(sharding.jump_shard(F.col("id"), shards).alias("s")).collect()


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 1.0], "a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_clusters_must_name_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(Session)


def test_hot_texts_get_the_classes_of_others(spark, monkeypatch):
    """Rows joined as hot ones (all, in a small table), as others, and of both kinds have the same classes."""
    words = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    texts = [words[0]] * 20 + [words[0] + " more"] * 3 + words[1:] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = []
    for hot in (minhash.HOT, 1, 2):
        monkeypatch.setattr(minhash, "HOT", hot)
        found.append(sorted(map(tuple, minhash.near_duplicates(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert [c for _, c, _ in found[0]] == [0] * 23 + list(range(23, 30))
