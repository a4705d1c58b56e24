"""Places of tokens, functions of code points, rules that are off, files by name, and the command line."""

import json
import re

from pyspark.sql import functions as F

from tidewright import api, cli
from tidewright.functions import text as T
from tidewright.operators.lexer import tokens
from tidewright.plans import config, corpus, engine, history, reports, training
from tidewright.sources import files
from tidewright.streaming import editor


def sources(spark, rows):
    return spark.createDataFrame(rows, "file string, source string, language string")


def test_places_of_long_and_repeated_files(spark):
    text = "".join(f"biến_{i} = 'a\nb' + {i}\n\n" for i in range(300))
    rows = tokens(sources(spark, [("f", text, "Python"), ("f", text, "Python"), (None, "a = 1\n", "Python"), (None, "a = 1\n", "Python"), ("n", None, "Python")]))
    per = {}
    for r in rows.collect():
        per.setdefault(r["row"], []).append(r)
    assert len(per) == 5
    for got in per.values():
        source = {"f": text, None: "a = 1\n", "n": ""}[got[0]["file"]].encode()
        for r in got:
            before = source[: r["start"]]
            assert source[r["start"] : r["end"]].decode() == r["raw"]
            assert (r["line"], r["col"]) == (before.count(b"\n") + 1, len(before) - before.rfind(b"\n"))
        assert [r["kind"] for r in got].count("EndOfFile") == 1


def test_local_rules_need_no_exchange(spark):
    found = engine.lint(sources(spark, [("f.py", "tên = 1", "Python")]), engine.Config(rules={f"VL{i:03d}": (i == 1, "info") for i in range(1, 12)}))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_all_rules_off(spark):
    off = engine.Config(rules={r: (False, "info") for r in engine.BUILT_IN})
    assert engine.lint(sources(spark, [("f.py", "tên = 1", "Python")]), off).count() == 0


def test_functions_of_code_points(spark):
    rows = spark.createDataFrame([("aé́漢🙂_9",), ("",), ("x" * 200,)], "s string")
    points, none, long = (r["p"] for r in rows.select(T.code_points(F.col("s")).alias("p")).collect())
    assert [(p["codepoint"], p["byte_offset"], p["byte_length"]) for p in points] == [(97, 0, 1), (233, 1, 2), (0x301, 3, 2), (0x6F22, 5, 3), (0x1F642, 8, 4), (95, 12, 1), (57, 13, 1)]
    assert [p["is_id_start"] for p in points] == [True] * 6 + [False] and none == [] and [p["byte_offset"] for p in long] == list(range(200))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(T.utf8_of(F.lit(c))) for c in (0x41, 0x1EC7, 0x1F642, 0xD800, 0x110000, -1)] == ["A", "ệ", "🙂", "�", "�", "�"]
    assert one(T.escape_json(F.lit('"\\\n\x01\x1f'))) == '\\"\\\\\\n\\u0001\\u001F' and one(T.hex4(F.lit("00e9"))) == 0xE9 and one(T.hex4(F.lit("xyz0"))) is None
    assert tuple(one(T.position_of(F.lit("ab\ncé\nd"), F.lit(6)))) == (2, 3, 6)
    assert [one(T.is_valid_utf8(F.lit(bytearray(b)))) for b in (b"Vi\xe1\xbb\x87t", b"\xff", b"")] == [True, False, True]


def test_frames_and_gate(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(editor.body_of(editor.frame_of(F.lit('{"é":1}')))) == '{"é":1}'
    assert one(editor.body_of(F.lit("Content-Length: 9\r\n\r\nshort"))) is None and one(editor.body_of(F.lit("X: 1\n\n{}"))) is None
    rows = spark.createDataFrame([("s", i, str(i) if i != 2 else None, m, None) for i, m in enumerate(["shutdown", "initialize", "initialized", "shutdown"])], "session string, seq int, id string, method string, error int")
    assert {r["seq"]: r["error"] for r in editor.gated(rows, "session").collect()} == {0: editor.NOT_INITIALIZED, 1: None, 2: None, 3: None}
    early = spark.createDataFrame([("t", 0, None, "initialized", None), ("t", 1, None, "exit", None)], "session string, seq int, id string, method string, error int")
    assert [r["seq"] for r in editor.gated(early, "session").collect()] == [1]


def test_named_files_and_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("tên = 1\n")
    (tmp_path / "odd.txt").write_text("x = 1\n")
    got = files.named_files(spark, [str(tmp_path / "d"), str(tmp_path / "odd.txt"), str(tmp_path / "d"), str(tmp_path / "d" / "a.py")])
    assert sorted(r["file"].rsplit("/", 1)[1] for r in got.collect()) == ["a.py", "odd.txt"]
    monkeypatch.chdir(tmp_path / "d")
    assert cli.main(["lint", str(tmp_path / "d"), "--context", "1"], spark) == 1 and "\n    | tên = 1\n    | ^\n    | \n    suggestion: ten" in capsys.readouterr().out
    assert cli.main(["lint", str(tmp_path / "d"), "--fix"], spark) == 1
    assert "[VL001]" in capsys.readouterr().out and (tmp_path / "d" / "a.py").read_text() == "ten = 1\n"
    assert cli.main(["lint", str(tmp_path / "none")], spark) == 3
    assert cli.main(["init"], spark) == 0 and cli.main(["init"], spark) == 1 and config.find_config(str(tmp_path / "d")) == str(tmp_path / "d" / ".tidewright.toml")
    (tmp_path / "n").write_text("ten_hang\n\nfoo\n")
    assert cli.main(["classify", str(tmp_path / "n")], spark) == 0 and "TransliteratedViet" in capsys.readouterr().out
    assert cli.main(["detect", str(tmp_path / "odd.txt")], spark) == 0 and "us-ascii" in capsys.readouterr().out


def test_api(spark):
    e = api.LintEngine(spark, "[rules.VL002]\nenabled = false\n")
    found = e.lint_source("tên = 1 # é x")
    assert {r["source_rule"] for r in found.collect()} == {"VL001"} and e.format(found, "gcc").count() == 2
    names = spark.createDataFrame([("tênKhách",), ("foo",)], "id string")
    assert [r["class"] for r in api.classify(names).collect()] == ["MixedVietnamese", "PureASCII"]
    assert len(api.FEATURE_NAMES) == 64 == len(api.feature_table(names).columns) - 1
    assert set(api.register(spark)) >= {"tw_has_vietnamese", "tw_has_exact_vietnamese", "tw_count_vietnamese", "tw_ascii_name", "tw_class", "tw_style", "tw_confidence", "tw_language", "tw_is_transliteration", "tw_ratio"}
    assert tuple(spark.sql("SELECT tw_has_vietnamese('tên'), tw_count_vietnamese('tên'), tw_ascii_name('tên')").first()) == (True, 1, "ten")


def test_text_report(spark):
    rows = sources(spark, [("f.py", "x = 1\ntên = 2", "Python")])
    report = reports.text_reports(rows, engine.lint(rows).where("rule_id = 'VL001'"), url=True).first()["report"]
    assert report.split("\n")[1:] == ["    | tên = 2", "    | ^", "    suggestion: ten or ten", "    see: " + reports.BASE_URL + "VL001", ""]


def test_text_report_context_and_colour(spark):
    rows = sources(spark, [("f.py", "a = 1\nb = 1\ntên = 2\nc = 1\nd = 1\ntên = 3", "Python")])
    found = engine.lint(rows).where("rule_id = 'VL001'")
    told = [r["report"].split("\n") for r in reports.text_reports(rows, found, context=1).orderBy("start").collect()]
    assert told[0][1:5] == ["    | b = 1", "    | tên = 2", "    | ^", "    | c = 1"] and told[1][1:4] == ["    | d = 1", "    | tên = 3", "    | ^"]
    wide = reports.text_reports(rows, found, context=9).orderBy("start").first()["report"].split("\n")
    assert [x[6:] for x in wide[1:8]] == ["a = 1", "b = 1", "tên = 2", "^", "c = 1", "d = 1", "tên = 3"]
    plain = [r["report"] for r in reports.text_reports(rows, found, True).orderBy("start").collect()]
    bright = [r["report"] for r in reports.text_reports(rows, found, True, color=True).orderBy("start").collect()]
    assert all("\x1b[1mf.py:" in x and "\x1b[32m^\x1b[0m" in x for x in bright) and [re.sub("\x1b\\[[0-9]+m", "", x) for x in bright] == plain


def test_corpus_and_history(spark):
    rows = spark.createDataFrame([("r", "b.py", "ten if x9 42 tên ten"), ("r", "a.py", "ten"), ("r", "z.txt", "zz"), ("q", "c.py", "getUser")], "repo string, path string, source string")
    curated = spark.createDataFrame([("getUser", 0, 1.0)], "id string, label int, confidence double")
    got = {r["id"]: (r["label"], r["source"]) for r in corpus.collect(rows, curated).collect()}
    assert got["getUser"] == (0, "curated") and got["ten"][1] == "r/a.py" and set(got) == {"getUser", "ten", "x9", "tên"}
    assert corpus.chosen_files(rows, 1).count() == 2
    v = spark.createDataFrame([(1, "p", "f"), (2, "q", "f")], "id int, project_id string, file_path string")
    new = spark.createDataFrame([(2, "x", "f"), (3, "x", "f"), (3, "y", "f")], "id int, project_id string, file_path string")
    assert sorted(r["id"] for r in history.insert_or_ignore(v, new).collect()) == [1, 2, 3]
    kept, left = history.delete_project(spark.createDataFrame([("p",), ("q",)], "id string"), v, "p")
    assert kept.count() == left.count() == 1


def test_split_and_scores(spark, tmp_path):
    corpus_rows = spark.createDataFrame([(f"n{i}", i % 2, 0.9) for i in range(400)], "id string, label int, confidence double")
    train, test = training.split(corpus_rows)
    assert train.count() + test.count() == 400 and 30 < test.count() < 100
    told = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, predicted int")
    s = training.scores(training.report(told)).first()
    assert round(s["accuracy"], 6) == 0.666667 and round(s["f1"], 6) == 0.666667
    assert training.load(str(tmp_path / "none")) is None
    assert json.loads(spark.createDataFrame([("a",)], "file string").selectExpr("to_json(struct(file)) j").first()["j"]) == {"file": "a"}
