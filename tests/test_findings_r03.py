"""What the findings of round 3 asked for."""

from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import lexer
from tidewright.plans import engine, reports

SOURCE = "# coding: latin-1\nten_khach = \"é\\\" \n\"\ndef so_luong(a):\n" + "\n" * 7 + "    raise ValueError('lỗi')\n    y = 1\nimport numpy as ten\ndanhSach = '''x\ny'''"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sources(spark, *texts):
    return spark.createDataFrame([(f"f{i}.py", t, "Python") for i, t in enumerate(texts)], "file string, source string, language string")


def test_limits_and_doubles_lint_once(spark):
    found = engine.lint(sources(spark, SOURCE, None, ""))
    for once in (engine.lint(sources(spark, SOURCE), engine.Config(max_violations=3)), engine.without_doubles(found)):
        assert "Join" not in plan(once)
    every = engine.lint(sources(spark, SOURCE, SOURCE)).groupBy("file", "source_rule").count().collect()
    kept = engine.lint(sources(spark, SOURCE, SOURCE), engine.Config(max_violations=4)).groupBy("file", "source_rule").count().collect()
    for name in ("f0.py", "f1.py"):
        so_far, want = 0, {}
        for rule, n in sorted((r["source_rule"], r["count"]) for r in every if r["file"] == name):
            if so_far < 4:
                want[rule] = n
            so_far += n
        assert {r["source_rule"]: r["count"] for r in kept if r["file"] == name} == want


def test_texts_without_findings_are_not_sorted(spark):
    """Of a token that no rule finds anything at, only marks go to the exchange."""
    text = "plain = '" + "x" * 200_000 + "'\n" + SOURCE
    found = engine.lint(sources(spark, text))
    assert found.where("rule_id = 'VL010'").count() == 1 and found.where("rule_id = 'VL009'").count() == 1 and found.where("rule_id = 'VL011'").count() == 1
    assert "_kept" in plan(found)


def test_pieces_of_long_sources_are_cut_in_parts(spark, monkeypatch):
    rows = sources(spark, SOURCE * 3, "", None, "á b\r\n\tc")
    whole = lexer.tokens(rows, keep_space=True).drop("row").collect()
    import pyarrow as pa

    texts, languages = pa.array([SOURCE * 3, "", None, "á b\r\n\tc"]), pa.array(["Python"] * 4)
    monkeypatch.setattr(lexer, "SHORT", 4)
    monkeypatch.setattr(lexer, "PIECES", 3)
    parts = [t for l in lexer._placed(texts, languages, True).to_pylist() for t in l or [{"pos": 0, "raw": "", "start": 0, "line": 1, "col": 1}]]
    assert [(r["pos"], r["raw"], r["start"], r["line"], r["col"]) for r in whole] == [(t["pos"], t["raw"], t["start"], t["line"], t["col"]) for t in parts]
    assert "".join(r["raw"] for r in whole if r["file"] == "f0.py") == SOURCE * 3
    assert lexer.tokens(rows).where(F.col("raw").rlike(r"^\s")).count() == 0


def test_fixes_of_many_places(spark):
    """Sources are put together once, not once more for each place."""
    rows = sources(spark, "ten_khach = 1\n" * 20_000, None, "x")
    found = rows.where("source like 'ten%'").select("file", F.explode(F.sequence(F.lit(0), F.lit(19_999))).alias("i")).select(
        "file", F.lit("VL001").alias("rule_id"), (F.col("i") * 14).alias("start"), (F.col("i") * 14 + 9).alias("end"), F.array(F.lit("á")).alias("fixes")
    )
    got = {r["file"]: r["fixed"] for r in engine.apply_fixes(rows, found).collect()}
    assert got == {"f0.py": "á = 1\n" * 20_000, "f1.py": None, "f2.py": "x"}
    assert "aggregate(" not in plan(engine.apply_fixes(rows, found))


def test_reports_meet_their_own_lines(spark):
    """No diagnostic carries its whole source; lines past the end show the first."""
    rows = sources(spark, "a\nb\nc", "", "d")
    found = spark.createDataFrame(
        [(f, n, 1, "info", "VL001", "m", [], 0) for f in ("f0.py", "f1.py") for n in (0, 1, 3, 9)], "file string, line int, col int, severity string, rule_id string, message string, fixes array<string>, start int"
    )
    made = reports.text_reports(rows, found, context=1)
    said = sorted(r["report"].split("[VL001]: m\n")[1] for r in made.where("file = 'f0.py'").collect())
    line = lambda *parts: "".join(f"    | {p}\n" for p in parts)
    assert said == sorted(["", line("a", "^", "b"), line("b", "c", "^"), line("a", "^")])
    assert {r["report"].split("m\n")[1] for r in made.where("file = 'f1.py'").collect()} == {""}
    assert "split(source" not in plan(made).split("Join")[0]


def test_code_points_of_a_batch(spark):
    texts = ["aé\U0001F600_9", "", None, "ẽ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", text.code_points(F.col("s")).alias("p"))
    assert "aggregate(" not in plan(rows)
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in rows.collect()}
    assert got[0] == [(97, 0, 1, False, True, True), (233, 1, 2, True, True, True), (0x1F600, 3, 4, False, True, True), (95, 7, 1, False, True, True), (57, 8, 1, False, False, True)]
    assert got[1] == got[2] == [] and got[3] == [(0x1EBD, 0, 3, True, True, True)]


def test_statements_are_rows(spark):
    """statements are cut once and declared once, by no state over arrays; names stand where their statement first says them."""
    from tidewright.operators.declarations import declarations

    code = "namespace a::b {\nstruct R {\n  int x = g(1; 2), y[3];\n  enum class E { A = 1, B };\n  void f(int p) const { auto l = x; }\n  ~R();\n} r;\n}\n}\nint z; // int w;\n#define int v;\nint last"
    table = spark.createDataFrame([("a.cpp", code), ("b.cpp", None), ("c.cpp", "")], "file string, source string")
    found = declarations(table)
    assert "aggregate(" not in plan(found) and plan(found.select("qualified_name")).count("cut(") == 1
    assert "StartsWith(s" not in "".join(line for line in plan(found).split("\n") if "Filter" in line)
    got = {(r["decl_kind"], r["qualified_name"], r["line"], r["col"]) for r in found.collect()}
    assert got == {
        ("namespace", "a::b", 1, 14), ("struct", "a::b::R", 2, 8), ("field", "a::b::R::x", 3, 7), ("field", "a::b::R::y", 3, 20), ("enum", "a::b::R::E", 4, 14), ("enumerator", "a::b::R::E::A", 4, 18),
        ("enumerator", "a::b::R::E::B", 4, 25), ("function", "a::b::R::f", 5, 8), ("parameter", "p", 5, 14), ("variable", "l", 5, 30), ("function", "a::b::R::~R", 6, 4), ("variable", "a::b::r", 7, 3),
        ("variable", "z", 10, 5), ("variable", "last", 12, 5),
    }


def test_digests_are_made_as_tokens_are_read(spark):
    """nothing is shuffled for a digest, sources that go over batches are whole, and sources without tokens have none."""
    import hashlib

    from tidewright.queries import digests

    rows = sources(spark, (SOURCE + "\n") * 60, "x", None, SOURCE).coalesce(1)
    toks = lexer.tokens(rows)
    made = digests(toks)
    assert "Aggregate" not in plan(made) and "Sort" not in plan(made)
    want = {}
    for t in toks.collect():
        want.setdefault(t["file"], []).append(":".join(map(str, (t["pos"], t["kind"], hashlib.md5(t["raw"].encode()).hexdigest(), t["start"], t["end"], t["line"], t["col"]))))
    assert len(want["f0.py"]) > 2 * lexer.BATCH
    assert {(r["file"], r["n"], r["digest"]) for r in made.collect()} == {(f, len(l), hashlib.md5(",".join(l).encode()).hexdigest()) for f, l in want.items()}
    assert digests(toks.where("file = 'f2.py' and raw <> ''")).count() == 0


def test_bytes_are_counted_once_for_detection(spark):
    """no patterns over bytes, and each source's bytes are counted once; no character goes over a source's end or the part that is looked at."""
    import re

    from tidewright.operators import encoding

    unit = rb"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xFF][\x80-\xBF]{3}"
    texts = [b"", "tiếng Việt \U0001F600".encode(), b"abc\xc3", b"\xa9\xc3", b"\xe1\xba", b"\xbf\xf0\x9f\x98", bytes(range(256)), bytes(range(255, -1, -1)) * 3] * 20
    facts = encoding._facts(texts)
    assert facts["units"].tolist() == [len(re.findall(unit, t)) for t in texts] and facts["parts"].tolist() == [len(re.findall(unit + rb"|(?s:.)", t)) for t in texts]
    assert facts["high"].tolist() == [sum(b > 127 for b in t) for t in texts] and facts["total"].tolist() == [len(t) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, b"", b"\xef\xbb\xbfa", b"abc", "ờ".encode() * 5000])], "i int, b binary")
    found = rows.select("i", encoding.detect(F.col("b")).alias("d")).select("i", "d.*")
    assert "regexp" not in plan(found) and plan(found).count("told(") == 1
    assert [r["encoding"] for r in found.orderBy("i").collect()] == ["utf-8", "us-ascii", "utf-8-sig", "us-ascii", "utf-8"]


def test_rules_of_marked_tokens_read_no_others(spark):
    """tokens that are ASCII stay in the lexer where only rules of marked ones are asked for; what is found is the same."""
    from tidewright.operators import rules

    rows = sources(spark, SOURCE, "# lỗi a\nx = 'á'\ntén = 1\n'''đ b'''", None, "").withColumn("row", F.monotonically_increasing_id())
    every, some = lexer.tokens(rows), lexer.tokens(rows, marked=True)
    want = every.where("raw = '' or octet_length(raw) > length(raw)")
    assert sorted(some.collect()) == sorted(want.collect()) and some.count() < every.count()
    for rule in rules.MARKED:
        assert sorted(rules.run_rules(some, [rule]).collect()) == sorted(rules.run_rules(every, [rule]).collect()) != []
