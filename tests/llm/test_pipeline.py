"""The pipeline's stages and op3 against brute force on planted documents."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidewright.llm import tokens, toxicity

SECRET = "Zx9Qw8Er7Ty6"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MADE = {"en": "the and ing tion with ed", "de": "der und ung sch ein ich", "fr": "le eux ment que ais ou"}


def planted():
    rng = random.Random(8)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        part = MADE[lang].split()
        words = ["".join(rng.choice(part) for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(60, 400))]
        if i % 7 == 0:
            words[30] = f'db_pwd="{SECRET}"'
        rows.append((i, " ".join(words), lang, f"s{i % 4}"))
    for i in range(0, 90, 9):  # near and exact copies
        words = rows[i][1].split()
        words[-1] = "changed"
        rows += [(100 + i, " ".join(words), rows[i][2], rows[i][3]), (200 + i, rows[i][1].upper(), rows[i][2], "s1")]
    rows += [(300, None, "en", "s0"), (301, "12 34", "en", "s0"), (302, "", "de", "s0")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


def brute_kept(rows):
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].lower().split()] for i in range(len(w) - 4)} for r in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i for i in root if root[i] == i}


def brute_mix(rows):
    """Targets: three times a source at most, else by weights 1, 2, 3 in turn, as many words in all as there are."""
    n = Counter()
    for r in rows:
        n[r[3]] += len(r[1].split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(n))}
    low, high = 0.0, 3.0 * sum(n.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n[s], weight[s] * level) for s in n) < sum(n.values()) else (low, level)
    return {s: min(3 * n[s], weight[s] * high) for s in n}


def brute_packs(lengths, size):
    packs = []
    for n in sorted(lengths, reverse=True):
        if not packs or min(packs) + n > size:
            packs.append(0)
        packs[packs.index(min(packs))] += n
    return sorted(packs)


@pytest.fixture(scope="module")
def stages(spark):
    out, table = {}, spark.createDataFrame(planted(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, table, None).collect()
        out[name] = [tuple(r) for r in rows]
        if name != "packing":
            table = spark.createDataFrame(rows, SCHEMA)
    return out


def test_stages_of_documents(stages):
    assert sorted(stages["language"]) == sorted(r for r in planted() if r[0] < 300)
    assert {r[0] for r in stages["near_dedup"]} == brute_kept(stages["language"]) == set(range(90))
    assert set(stages["near_dedup"]) <= set(stages["language"]) and len(stages["near_dedup"]) == 90
    want = [(i, t.replace(SECRET, "[SECRET]"), lang, s, len(t.replace(SECRET, "[SECRET]"))) for i, t, lang, s, _ in stages["near_dedup"]]
    assert sum("[SECRET]" in r[1] for r in want) == 13 and sorted(stages["secrets"]) == sorted(want)


def test_run_writes_and_reads_its_stages(spark, tmp_path):
    spark.createDataFrame(planted(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 60


def test_mixing_stage(stages):
    target, taken, biggest = brute_mix(stages["secrets"]), Counter(), Counter()
    assert set(stages["mixing"]) <= set(stages["secrets"]) and max(Counter(stages["mixing"]).values()) <= 3
    for r in stages["mixing"]:
        taken[r[3]] += len(r[1].split())
    for r in stages["secrets"]:
        biggest[r[3]] = max(biggest[r[3]], len(r[1].split()))
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in target)


def test_packing_stage(stages):
    encode = tokens.codec("word_bpe_49k.json", ids=True).encode
    lengths = []
    for r in stages["mixing"]:
        n = len(encode(r[1])) // 4 + 1
        lengths += [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
    packs = defaultdict(list)
    for _, _, length, _, _, sequence, offset in stages["packing"]:
        packs[sequence].append((offset, length))
    assert sorted(x for p in packs.values() for _, x in p) == sorted(lengths)
    for p in packs.values():
        ends = [0, *(a + n for a, n in sorted(p))]
        assert [a for a, _ in sorted(p)] == ends[:-1]
    assert sorted(max(a + n for a, n in p) for p in packs.values()) == brute_packs(lengths, 4096)


def test_toxicity_of_planted_documents(spark):
    rng = random.Random(9)
    clean, bad = ["river", "garden", "window", "paper", "yellow", "simple"], ["vilefool", "scumrot", "hatewretch"]
    rows = []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(40)]
        for k in range(rng.randint(4, 12) if i % 2 else 0):
            words[k * 3] = rng.choice(bad)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "12")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_documents(docs, labels).collect()}
    assert len(got) == 403 and all(got[i]["severity"] == 0 and not got[i]["toxic"] for i in (900, 901, 902))
    wrong = [i for i in range(200, 400) if got[i]["toxic"] != bool(i % 2)]  # never labelled
    assert len(wrong) <= 3 and all(i % 2 and sum(w in bad for w in rows[i][1].split()) <= 5 for i in wrong)
    share = {i: sum(w in bad for w in t.split()) for i, t in rows if i >= 200}
    many, few = ([got[i]["severity"] for i in share if i % 2 and f(share[i])] for f in (lambda n: n >= 10, lambda n: n <= 5))
    assert sum(many) / len(many) > sum(few) / len(few)
