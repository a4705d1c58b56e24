"""Configuration, reports, files, grammars, declarations and the editor stream."""

import json

from pyspark.sql import functions as F

from tidewright.functions import grammars as G
from tidewright.plans import config, engine, reports
from tidewright.sources import files
from tidewright.streaming import editor


def source(spark, text, file="f.py"):
    return spark.createDataFrame([(file, text, "Python")], "file string, source string, language string")


def test_config():
    p = config.parse_config('# c\n[project]\nroot = "src"\n[lint]\nmax_violations = 7x\nfail_on_warning = true\n[rules.VL005]\nenabled = true\n[rules.VL007]\nenabled = false\nseverity = "odd"\ndepth = "3"\n')
    assert (p.root, p.lint.max_violations, p.fail_on_warning) == ("src", 7, True)
    assert p.lint.rules == {"VL005": (True, "warning"), "VL007": (False, "info")}
    assert (p.number("VL007", "depth"), p.number("VL007", "none", 4), p.flag("VL007", "depth")) == (3, 4, False)
    again = config.parse_config(config.default_config())
    assert again.lint.rules["VL007"] == (False, "info") and again.lint.rules["VL005"] == (True, "error")
    assert config.parse_config("").lint.rules == {}


def test_reports(spark):
    rows = source(spark, "tên = \"lỗi\"\n")
    found = engine.lint(rows)
    told = json.loads(reports.json_documents(found).first()["report"])
    assert [t["rule"] for t in told] == ["VL001", "VL002", "VL007"] and told[0]["fixes"] == ["ten", "ten"]
    sarif = json.loads(reports.sarif_documents(found).first()["report"])
    results = sarif["runs"][0]["results"]
    assert [r["level"] for r in results] == ["warning", "warning", "note"] and sarif["version"] == "2.1.0"
    assert results[2]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 8}
    lines = [r["x"] for r in found.select(reports.gcc_line().alias("x")).collect()]
    assert all(x.startswith("f.py:1:") and x.endswith("]") for x in lines)
    assert reports.summary(rows, found).first()["text"] == "Files scanned: 1\nWarnings: 2\nInfos: 1"
    clean = engine.lint(source(spark, "x = 1"))
    assert "No violations found" in reports.summary(rows, clean).first()["text"] and reports.json_documents(clean).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"\xef\xbb\xbft = 1\n")
    (tmp_path / "y.js").write_text("let é = 1")
    (tmp_path / "z.txt").write_text("no")
    got = {r["file"].rsplit("/", 1)[1]: (r["source"], r["language"], r["encoding"]) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"x.py": ("t = 1\n", "Python", "utf-8-sig"), "y.js": ("let é = 1", "JavaScript", "utf-8")}
    lines = spark.createDataFrame([('{"id": "a", "label": 1}',), ("# c",), ("",), ('{"id": "b", "label": 9}',), ('{"label": 1}',), ('{"id": "c", "label": 0, "confidence": 0.2}',)], "value string")
    assert sorted(map(tuple, files.labelled_corpus(lines).collect())) == [("a", 1, 1.0), ("c", 0, 0.2)]
    assert files.labelled_corpus(lines, 0.7).count() == 1


def test_grammars_and_declarations(spark):
    paths = spark.createDataFrame([("a/b.pyi",), ("x.h++",), ("Makefile",), ("a.xyz",)], "p string")
    assert [r["g"] for r in paths.select(G.grammar_of(F.col("p")).alias("g")).collect()] == ["Python", "C++", None, None]
    assert G.grammar_table(spark).count() == sum(len(e.split()) for _, e in G.GRAMMARS)
    schema = "file string, decl_kind string, qualified_name string, name string, line int, col int, system boolean"
    rows = spark.createDataFrame([("r/a.cpp", "var", "n::tên", "tên", 1, 2, False), ("r/a.pb.cc", "var", "tên", "tên", 1, 2, False), ("r/a.cpp", "var", "á", "á", 1, 2, False), ("/usr/a.h", "var", "á", "á", 1, 2, True), ("r/b.cpp", "var", "x", "x", 1, 2, False)], schema)
    assert sorted((r["file"], r["rule_id"], r["fix"]) for r in G.declaration_findings(rows, "r/").collect()) == [("a.cpp", "VL-AST-001", "a"), ("a.cpp", "VL-AST-002", "ten")]


def message(method, uri, **more):
    return json.dumps({"jsonrpc": "2.0", "method": method, "params": {"textDocument": {"uri": uri, **{k: v for k, v in more.items() if k in ("text", "version", "languageId")}}, **{k: v for k, v in more.items() if k == "contentChanges"}}})


def test_edits():
    at = lambda a, b: {"line": a, "character": b}
    assert editor.changed("ab\nçd\n", {"range": {"start": at(1, 1), "end": at(1, 2)}, "text": "X"}) == "ab\nçX\n"
    assert editor.changed("ab", {"range": {"start": at(0, 9), "end": at(5, 0)}, "text": "!"}) == "ab!"
    assert editor.changed("ab", {"text": "new"}) == "new"
    assert editor.apply_message(None, editor.CHANGE, {"version": 2}, [{"text": "x"}]) is None


def test_messages(spark):
    raw = spark.createDataFrame([(0, "{"), (1, '{"id": "1"}'), (2, '{"id": "2", "method": "no"}'), (3, '{"method": "no"}'), (4, message(editor.OPEN, "u"))], "seq long, value string")
    assert [r["error"] for r in editor.messages(raw).orderBy("seq").collect()] == [editor.PARSE_ERROR, editor.INVALID_REQUEST, editor.METHOD_NOT_FOUND, None, None]


def test_stream(spark, tmp_path):
    sent = tmp_path / "in"
    sent.mkdir()
    rows = [
        {"seq": 1, "value": message(editor.OPEN, "a.py", text="x = 1\n", version=1)}, {"seq": 2, "value": message(editor.CHANGE, "a.py", version=2, contentChanges=[{"range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}}, "text": "tên"}])},
        {"seq": 3, "value": message(editor.OPEN, "b.py", text="á", version=1)}, {"seq": 4, "value": message(editor.CLOSE, "b.py")}, {"seq": 5, "value": message(editor.CHANGE, "c.py", version=1, contentChanges=[{"text": "á"}])},
    ]
    (sent / "m.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("seq long, value string").json(str(sent))
    out = {}
    query = editor.start(stream, lambda df, _: out.update({r["uri"]: json.loads(r["message"]) for r in df.collect()}), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(120)
    assert set(out) == {"a.py", "b.py"} and out["b.py"]["params"]["diagnostics"] == []
    told = out["a.py"]["params"]
    assert told["version"] == 2 and [d["code"] for d in told["diagnostics"]] == ["VL001", "VL002"]
    assert told["diagnostics"][0]["range"] == {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 4}}


def test_hovers_and_actions(spark):
    found = engine.lint(source(spark, "tên = 1"))
    asked = spark.createDataFrame([("1", "f.py", 0, 1), ("2", "f.py", 0, 5)], "id string, uri string, line int, character int")
    got = {r["id"]: r["value"] for r in editor.hovers(asked, found).collect()}
    assert got["1"].startswith("**[VL001]**") and got["1"].endswith("`ten`, `ten`") and got["2"] is None
    actions = [json.loads(r["action"]) for r in editor.code_actions(found).orderBy("rule_id").collect()]
    assert [a["edit"]["changes"]["f.py"][0]["newText"] for a in actions] == ["ten", "ten", "ten"]
