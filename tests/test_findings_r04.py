"""What the findings of round 4 asked for."""

import os

import pytest
from pyspark.sql import functions as F

from tidewright.operators import rules
from tidewright.plans import engine, reports, service

from test_marks import made

TINY = "/root/testdata/sf0.001"
SOURCES = "row long, file string, source string, language string"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def asked(spark, name):
    import __spark_entry__

    if not os.path.isdir(TINY):
        pytest.skip("no tables")
    return __spark_entry__.queries()[name](spark, TINY)


def odd(spark):
    """Sources of one name, of none, empty, null, too long and invalid ones beside those of test_marks."""
    more = [(900, None, "tên = 1\nso_luong = 2", "Python"), (901, "f1", "á", None), (902, "f1", "b á\n" * 5000, "Python"), (903, "inv", "tên = 1\n", "Python"), (904, "f1", "\n\ntên", "Python")]
    rows = spark.createDataFrame([(r, f"{f}_{r}", *x) for r, f, *x in made(300)] + more, SOURCES)
    invalid = F.concat(F.col("source"), F.unhex(F.lit("FF61")).cast("string"))
    return rows.withColumn("source", F.when(F.col("file") == "inv", invalid).otherwise(F.col("source"))).repartition(3)


@pytest.mark.parametrize("config", [engine.Config(), engine.Config({"VL001": (True, "fatal"), "VL007": (False, "info"), "VL008": (True, "error"), "VL000": (True, "info")}, extra_rules=("VL-EX-001", "VL-EX-002"))])
def test_found_in_place_as_by_lint(spark, config):
    rows = odd(spark)
    every = lambda row, file, source, found: ((row, file, *f) for f in found)
    schema = "row long, file string, source_rule string, rule_id string, severity string, message string, identifier string, fixes array<string>, line int, col int, start int, end int"
    got = engine.in_place(rows, every, schema, config, longest=10_000)
    want = engine.lint(rows, config, longest=10_000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert {r["source_rule"] for r in want.select("source_rule").distinct().collect()} >= set(config.enabled()) | {"VL000"}
    with pytest.raises(ValueError):
        engine.in_place(rows, every, schema, engine.Config(max_violations=1))


def test_nothing_is_found_without_rules(spark):
    config = engine.Config({r: (False, "info") for r in rules.BUILT_IN})
    assert reports.linted_reports(odd(spark).where("source is not null"), config).count() == 0


@pytest.mark.parametrize(("url", "color", "context"), [(False, False, 0), (True, True, 2), (True, False, 1)])
def test_reports_in_place(spark, url, color, context):
    """reports as text_reports has them, of sources that are read once."""
    rows = odd(spark).where("file is not null and not (file = 'f1') and file <> 'inv'")
    want = reports.text_reports(rows, engine.lint(rows), url, color, context)
    got = reports.linted_reports(rows, None, url, color, context)
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    digests = reports.linted_reports(rows, None, url, color, context, digest=True)
    assert sorted(map(tuple, digests.collect())) == sorted(map(tuple, want.withColumn("report", F.md5("report")).collect()))
    assert not any(x in plan(digests).split("Repartition")[0] for x in ("Join", "Sort", "Window", "Generate"))


def test_report_context_shuffles_no_lines(spark):
    """the query's lines went to a join five times; now sources alone are dealt to cores."""
    assert "Join" not in plan(asked(spark, "z03_report_context"))


def test_text_reports_shuffle_no_lines(spark):
    """as F1."""
    assert "Join" not in plan(asked(spark, "x13_text_reports"))


@pytest.mark.parametrize("camel", [False, True])
def test_fixes_in_place(spark, camel):
    """sources are put together where they are cut, and meet no join."""
    rows = odd(spark)
    want = engine.apply_fixes(rows, engine.lint(rows), camel).select("row", "file", F.hex("fixed").alias("fixed"))
    got = engine.linted_fixes(rows, None, camel).select("row", "file", F.hex("fixed").alias("fixed"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert not any(x in plan(asked(spark, "c07_apply_fix")) for x in ("Join", "Sort", "Window", "Aggregate"))


def test_events_in_place(spark):
    """a source's events are not gathered; the last one counts the others."""
    rows = odd(spark).withColumn("file", F.concat_ws("_", "file", F.col("row").cast("string")))
    want = service.event_stream(rows, engine.lint(rows))
    got = service.linted_events(rows)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not any(x in plan(asked(spark, "x10_event_stream")) for x in ("Join", "Sort", "Window", "Aggregate"))


def test_statements_of_one_shape_are_told_once(spark, monkeypatch):
    """what a statement declares hangs on its words but names, and is told once for all that differ in names alone; no pattern is held against it in columns."""
    import pyarrow as pa

    from tidewright.operators import declarations as D
    from tidewright.operators import lexer

    one = "class L{0} : public B<int> {{\n  int f_{0} = g(1, 2), *g_{0}[3];\n  virtual void m_{0}(int p_{0}) const {{ auto l_{0} = f_{0}; }}\n  ~L{0}();\n  enum class E_{0} {{ A_{0} = 1, B_{0} }};\n}} v_{0};\n"
    texts = pa.array(["namespace n::m {\n" + "".join(one.format(i) for i in range(200)) + "}\nchar c = '\0';", "int chạy(int doé);", ""])
    told, of_shape = [], D._of_shape
    monkeypatch.setattr(D, "_of_shape", lambda *a: told.append(a) or of_shape(*a))
    found = D._declared(lexer._placed(texts, pa.array(["Cpp"] * 3), False), {}).to_pylist()
    assert len(told) < 20 and len(found[0]) == 200 * 11 + 2 and found[2] == []
    lead = "n::m::L0::"
    assert sorted((x["decl_kind"], x["qualified_name"], x["line"]) for x in found[0][1:12]) == sorted([
        ("class", "n::m::L0", 2), ("field", lead + "f_0", 3), ("field", lead + "g_0", 3), ("function", lead + "m_0", 4), ("parameter", "p_0", 4), ("variable", "l_0", 4), ("function", lead + "~L0", 5),
        ("enum", lead + "E_0", 6), ("enumerator", lead + "E_0::A_0", 6), ("enumerator", lead + "E_0::B_0", 6), ("variable", "n::m::v_0", 7),
    ])
    assert [(x["decl_kind"], x["name"]) for x in found[1]] == [("function", "chạy"), ("parameter", "doé")]
    rows = spark.createDataFrame([("a.cpp", "int a;")], "file string, source string")
    assert not any(x in plan(D.declarations(rows)) for x in ("regexp", "RLIKE", "rlike"))


def test_sources_without_raw_strings_are_cut_alike():
    """the pattern without raw strings is taken where a source has none, and cuts as the whole one does."""
    import pyarrow as pa

    from tidewright.operators import lexer

    texts = ["int x = 'R';\n#define a \\\n b\n// c\n/* d */ \"e\" u8\"f\" é 0x1F->y", 'auto s = R"(a;b)"; R"x(c)x"', "", "R", "'''\"\\"]
    for t in texts:
        cut, _ = lexer._cut(pa.array([t]), pa.array(["Cpp"]))
        assert cut.to_pylist() == [*(m[0] for m in lexer._PATTERNS["Cpp"].finditer(t)), ""]
    assert not lexer._NOT_RAW.groups


def _walk(nodes):
    """A file's tokens by its nodes (node, start, end, row, column, kind, depth), one after another; no number is -1."""
    out, covered, nodes = [], -1, sorted(nodes)
    for i, (node, start, end, row, column, kind, depth) in enumerate(nodes):
        last = i + 1 == len(nodes)
        leaf = last or not (nodes[i + 1][6] > depth if depth is not None and nodes[i + 1][6] is not None else nodes[i + 1][1] < end)
        whole = kind in ("Comment", "StringLiteral") and end > start
        if kind and end > start and (whole or leaf) and covered < end:
            out.append((node, start, end, row, column, kind))
        covered = max(covered, end) if whole else covered
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("with_depth", [True, False])
def test_nodes_are_packed_before_they_are_dealt(spark, monkeypatch, parts, with_depth):
    """trees whose nodes lie anywhere are walked as one by one, and no window is made; a tree's nodes take a few bytes each."""
    import random

    from tidewright.operators import trees

    rng = random.Random(parts)
    kinds = {"identifier": "Identifier", "comment": "Comment", "string": "StringLiteral", "if": "Keyword", "call": None}
    rows, want = [], {}
    for f in range(60):
        nodes, at = [], 0
        for n in rng.sample(range(1 << 40), rng.randint(0, 80)):
            nodes.append(n)
        tree = []
        for n in sorted(nodes):
            at += rng.randint(0, 300 if f % 7 else 1 << 24)
            kind = rng.choice([*kinds])
            depth = rng.choice([None, 1, 2, 3, 400]) if with_depth else None
            tree.append((n - (1 << 39), at, at + rng.choice([0, 1, 5, 400, 1 << 20]), rng.randint(0, 1 << 20), rng.randint(0, 1 << 10), kinds[kind], depth))
            rows.append((f"f{f}.py", tree[-1][0], kind, kind != "if", *tree[-1][1:5], depth))
        if tree:
            want[f"f{f}.py"] = _walk(tree)
    rows += [(None, 1, "comment", True, 0, 9, 0, 0, 1), ("null.py", 1, None, True, 0, 9, 0, 0, 1), ("f0.py", 5, None, True, 0, 1 << 30, 0, 0, 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "file string, node long, type string, named boolean, start int, end int, row int, column int, depth int").repartition(parts)
    found = trees.walked(table if with_depth else table.drop("depth"))
    assert {r["file"]: [tuple(t) for t in r["tree"]] for r in found.collect()} == want
    assert "Window" not in plan(found)
    odd = spark.createDataFrame([("a.py", None, "comment", True, 0, 3, None, 0), ("a.py", 2, "identifier", True, None, 9, 1, 1), ("a.py", 3, "identifier", True, 4, 6, 1, None)], "file string, node long, type string, named boolean, start int, end int, row int, column int")
    assert [tuple(t) for t in trees.walked(odd).first()["tree"]] == [(None, 0, 3, None, 0, "Comment"), (3, 4, 6, 1, None, "Identifier")]


def test_packed_nodes_come_out_alike():
    """F6"""
    import numpy as np

    from tidewright.operators import trees

    rng = np.random.default_rng(5)
    n = 5000
    kind = rng.integers(0, 5, n)
    start = np.cumsum(rng.integers(1, 9, n))
    placed = [np.where(kind > 0, x, 0) for x in (start + rng.integers(0, 20, n), np.cumsum(rng.integers(0, 2, n)), rng.integers(0, 90, n))]
    given = [np.arange(n) * 2, start, rng.integers(0, 9, n), kind]
    packed = trees._pack(*given, placed)
    assert len(packed) < 9 * n and all(np.array_equal(a, b) for a, b in zip([*given, *placed], trees._unpack(packed), strict=True))
    assert all(len(x) == 0 for x in trees._unpack(trees._pack(*[np.zeros(0, np.int64)] * 4, [np.zeros(0, np.int64)] * 3)))
    assert trees._tokens_of(trees.pa.array([None, []], trees.pa.list_(trees.pa.binary())), True).to_pylist() == [[], []]
