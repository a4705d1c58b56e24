"""op11, op12 and op13 against brute force, and their SQL; nulls, ties, repeats, empty tables and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import fim, periodic, quality

SCHEMA = "doc_id long, text string, key string, n string, part long, chunk string, score long, _giant int"


def docs(spark, rows):
    """With columns that operators use themselves."""
    return spark.createDataFrame([(i, t, "k", "n", 1, "c", 7, 0) for i, t in rows], SCHEMA).repartition(3)


ODD = [(None, None), (None, "a null id"), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, "é x \U0001f600  "), (5, "\x0b\x0c\r\x1c\x85 a"), (6, "<P> a b c d"), (7, "x" * 70_000), (8, "one"), (9, "a " * 30_000)]


def brute_runs(x):
    """Every stretch of every period, its least period by trial."""
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(x[k] == x[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out)


def made_words(rng):
    x = []
    for _ in range(rng.randint(0, 8)):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, rng.choice([2, 5, 17])))]
        x += (unit * 9)[: rng.randint(1, len(unit) * 8)] + [rng.choice("abz")] * rng.randint(0, 1)
    return x


@pytest.mark.parametrize("symbols", [1, 2, 64])
def test_runs_against_brute_force(symbols, monkeypatch):
    monkeypatch.setattr(periodic, "SYMBOLS", symbols)
    rng = random.Random(symbols)
    cases = [made_words(rng) for _ in range(300)] + [[rng.choice("ab") for _ in range(60)] for _ in range(200)]
    cases += [list("a" * n) for n in range(9)] + [list("ab" * 4), list("ab" * 3), list("abc" * 4 + "ab"), list("aab" * 4 + "aa" * 4), [], ["x"]]
    for x in cases:
        assert periodic.runs_of(x) == brute_runs(x), x


def test_long_runs():
    """Periods beyond one block's symbols, within one document; stretches of one word take no longer for it."""
    unit = [str(i) for i in range(3001)]
    x = ["before"] * 7 + unit * 4 + unit[:11] + ["after"]
    assert periodic.runs_of(x) == [(0, 7, 1), (7, 4 * 3001 + 11, 3001)]
    assert periodic.runs_of(["a"] * 50_000) == [(0, 50_000, 1)] and periodic.runs_of(["a", "a"] * 10_000 + ["b"]) == [(0, 20_000, 1)]


def test_periodic_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(made_words(rng))) for i in range(10, 300)] + [(i, "  \n".join(f"w{k}" for k in range(i))) for i in range(300, 340)] + ODD
    got = sorted((tuple(r) for r in periodic.periodic_documents(docs(spark, rows), plant=True).collect()), key=str)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words) if n < 1000 else [(0, n, 1)]
        top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        want.append((i, len(runs), *(top[0] if top else (None,) * 3), top[0][1] * 1000 // top[0][2] if top else None, *(hashlib.sha256(s.encode()).hexdigest() for s in (lines, kept))))
    assert got == sorted(want, key=str)
    assert any(r[3] for r in want if r[0] and zlib.crc32(str(r[0]).encode()) % 10 == 0)
    assert periodic.periodic_documents(docs(spark, rows).limit(0)).count() == 0
    runs = {r["doc_id"]: r["runs"] for r in periodic.periodic_documents(docs(spark, [(1, "a b " * 9)]), keep_runs=True).collect()}
    assert [tuple(r) for r in runs[1]] == [(0, 18, 2)]


def brute_fim(i, t):
    t = t or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    form = "plain" if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    output = {"plain": t, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (i, len(tokens), form, *sizes, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), output)


@pytest.mark.parametrize(("chunk", "giant", "few"), [(1 << 16, 1 << 20, 10), (3, 20, 1000), (1, 0, 10), (7, 20, 10)])
def test_fill_in_middle(spark, chunk, giant, few, monkeypatch):
    """Texts cut in place, and giant ones by chunks, with cuts that are broadcast or joined by a shuffle."""
    monkeypatch.setattr(fim, "BROADCAST_ROWS", few)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab  \n\té😀") for _ in range(rng.randint(0, 40)))) for i in range(20, 260)] + [r for r in ODD if len(r[1] or "") < 1000 or chunk > 7]
    rows += [(20, rows[0][1]), (21, "another text under one id, long enough for chunks"), (None, "a giant text without an id, twice")] + [(None, "a giant text without an id, twice")]
    got = fim.fill_in_middle(docs(spark, rows), True, chunk, giant).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_fim(*r) for r in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs(spark, rows).limit(0)).count() == 0


def test_functions_of_chunks_compose():
    rng = random.Random(8)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("a \n") for _ in range(rng.randint(0, 4))) for _ in range(3))
        f, g, h = map(fim.scanned, (a, b, c))
        assert fim.composed(fim.composed(f, g), h) == fim.composed(f, fim.composed(g, h)) == fim.scanned(a + b + c)


def brute_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_rules():
    rng = random.Random(2)
    texts = [t for _, t in ODD if len(t or "") < 1000] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    texts += ["\n".join(" ".join(rng.choice("#ab|") for _ in range(2)) for _ in range(20)) for _ in range(50)] + ["a b c d e f g h " * 2, "a b c d e f g h i " * 2]
    for t in texts:
        assert quality.base_rules(t)[0] == brute_base(t), t


def test_quality(spark):
    """Labelled and unlabelled rows: bad ones are told, good ones stay, base rules come first."""
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice([""] * 9 + ["."]) for _ in range(n))
    bad = (lambda n: prose(n).replace(" ", "### "), lambda n: prose(n).upper().replace(" ", "!! "), lambda n: prose(n).replace(" ", " | "))
    rows = [(i, bad[i % 3](rng.randint(30, 200)) if i % 10 == 0 else prose(rng.randint(30, 300))) for i in range(1, 1200)]
    short = [(2000, "too short"), (2001, "a b c d e f g h i j " * 9), (2002, None), (None, prose(50)), (None, None), (1, rows[0][1])]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1, 600)] + [(2000, 1), (2001, 0), (7, None), (9999, 1)], "doc_id long, quality int")
    table = docs(spark, rows + short)
    got = [r.asDict() for r in quality.quality_documents(table, labels).collect()]
    assert len(got) == len(rows) + len(short)
    for r in got:
        text = next(t for i, t in rows + short if i == r["doc_id"] and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r["n_words"])
        base = brute_base(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r["base_failed"] and r["kept"])
    later = [r for r in got if r["doc_id"] and 600 <= r["doc_id"] < 1200]
    assert sum(r["kept"] for r in later if r["doc_id"] % 10 == 0) <= 1 and sum(not r["kept"] for r in later if r["doc_id"] % 10) <= 4
    again = quality.quality_documents(table.repartition(5), labels).select("doc_id", "n_words", "kept").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in quality.quality_documents(table, labels).select("doc_id", "n_words", "kept").collect())
    alone = quality.quality_documents(table, labels.where("quality = 1"))
    assert alone.where("kept = base_failed").count() == 0 and quality.quality_documents(table.limit(0), labels).count() == 0
    assert quality.quality_documents(table, labels.where(F.lit(False))).where("not kept and not base_failed").count() == 0


def test_forest_scores():
    """Far rows end earlier than near ones, and scores are the mean path's by hand."""
    x = np.concatenate([np.random.default_rng(1).normal(size=(300, 2)), [[50.0, 50.0]]])
    forest = quality.Forest(x, np.arange(301) == 300)
    s = forest.scores(x)
    assert s.argmax() == 300 and s[300] > 0.8 > np.quantile(s, 0.9)

    def path(tree, row):
        f, value, left, right, steps = tree
        at = 0
        while f[at] >= 0:
            at = left[at] if row[f[at]] < value[at] else right[at]
        return steps[at]

    for i in (0, 17, 300):
        mean = np.mean([path(t, x[i]) for t in forest.trees])
        assert np.isclose(s[i], 2 ** (-mean / quality.expected_path(forest.size)))
