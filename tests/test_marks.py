"""What F13 to F30 asked for: rules of a whole file are told where sources are cut, as windows over all tokens tell them."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import lexer, marks, rules
from tidewright.plans import engine, reports

PIECES = (
    "def so_luong(a):", "def ten_hang ()", "def x", "def", "as", "as ten", "import a as mã", "raise", "throw", "raise Error('lỗi')", "'lỗi'", '"plain"', "'''doc'''", "\n", "\n" * 7, "\n    ", "# coding: latin-1", "# lỗi a", "// lỗi b", "/* đ c */",
    "danhSach", "ten_hang", "SoLuong", "FOO_BAR", "getUser", "GetUser", "__", "QLKH", "sdt0905123456", "nv", "á", "bácSĩ", "tế́", "é", "`tố`", "R\"(lỗi)\"", "@ten", "9ten", "#", "+", "ten-hang", "日本", "ſdt_0905123456", "raise 'é", "\U0001F600", "\r\n", "\x0b",
)


def made(n, seed=3):
    rng = random.Random(seed)
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(PIECES) + rng.choice(["", " ", "\n", " : "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    languages = ["Python", "JavaScript", "Cpp", "TypeScript", "C", "Unknown"]
    return [(i, f"f{i % 90}", t, languages[i % 8] if i % 8 < 6 else "Python") for i, t in enumerate([*texts, "", None, "# coding: lỗi", "# lỗi a\n", " # coding"])]


def test_found_as_by_windows(spark):
    rows = spark.createDataFrame(made(400), "row long, file string, source string, language string")
    every = rows.withColumn("source", F.coalesce("source", F.lit("")))
    asked = (*rules.BUILT_IN, "VL-EX-001", "VL-EX-002")
    want = rules.run_rules(lexer.tokens(every), asked).collect()
    assert sorted(rules.find(rows, asked).collect()) == sorted(want) and {r["source_rule"] for r in want} == set(asked)
    for rule in asked:
        assert sorted(rules.find(rows, [rule]).collect()) == sorted(r for r in want if r["source_rule"] == rule)
    plan = rules.find(rows, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_texts_are_told_as_by_columns(spark):
    told = [(p, x) for p in {*PIECES, "None", "break", "delete", "co_await", "ten__hang_", "_ten", "x_TEN"} for x in ("Python", "JavaScript", "Cpp")]
    rows = spark.createDataFrame(told, "raw string, language string").select("*", lexer.token_kind(F.col("raw"), F.lit(1), F.col("language")).alias("kind"), T.identifier_class(F.col("raw")).alias("cls"), T.naming_style(F.col("raw")).alias("style"))
    for r in rows.collect():
        facts = marks.told(r["raw"], r["language"])
        assert marks.KINDS[facts & 31] == r["kind"], r
        assert marks.class_of(r["raw"]) == r["cls"], r
        assert (marks.style_of(r["raw"]) or r["style"]) == r["style"] and (marks.style_of(r["raw"]) != "") == (r["style"] in marks.STYLES), r


def test_long_texts_and_parts(spark, monkeypatch):
    texts = pa.array(["def ten_hang():\n" + "x = '" + "é" * 5000 + "'" + "\n" * 9, None, "", "as mã"])
    whole = marks._kept(texts, pa.array(["Python"] * 4), list(rules.BUILT_IN)).to_pylist()
    monkeypatch.setattr(lexer, "SHORT", 4)
    monkeypatch.setattr(lexer, "PIECES", 3)
    assert marks._kept(texts, pa.array(["Python"] * 4), list(rules.BUILT_IN)).to_pylist() == whole
    assert [t["flag"] for t in whole[0] if t["raw"] == "ten_hang"] == [True] and [t["pos"] for t in whole[1]] == [0]
    assert marks._kept(pa.array([], pa.string()), pa.array([], pa.string()), ["VL006"]).to_pylist() == []


def test_broken_sources_are_told_in_the_pass(spark):
    rows = spark.createDataFrame(made(20), "row long, file string, source string, language string")
    off = engine.Config(rules={r: (False, "info") for r in engine.BUILT_IN} | {"VL000": (True, "info")}, max_violations=1)
    got = engine.lint(rows, off, longest=200)
    long = {i for i, _, t, _ in made(20) if t is None or len(t.encode()) > 200}
    assert {r["row"] for r in got.collect()} == long and got.where("rule_id = 'VL000' and severity = 'error' and line = 1 and start = 0").count() == len(long)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_sorted_by_values(spark):
    rows = spark.createDataFrame(made(60), "row long, file string, source string, language string")
    found = engine.lint(rows).where("file = 'f3'")
    docs = reports.json_documents(found)
    assert "CASE WHEN (lambda" not in docs._jdf.queryExecution().optimizedPlan().toString()
    want = [(r["rule_id"], r["line"], r["col"]) for r in found.orderBy("start", "rule_id", "end").collect()]
    assert [(r["rule"], r["line"], r["col"]) for r in json.loads(docs.collect()[0]["report"])] == want != []
