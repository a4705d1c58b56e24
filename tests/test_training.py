"""Training data, models, service shapes and editor replies."""

import json

from pyspark.sql import functions as F

from tidewright.functions import grammars as G
from tidewright.operators.lexer import tokens
from tidewright.operators.rules import OUT, run_rules
from tidewright.plans import engine, service, training
from tidewright.streaming import editor

SOURCE = "# coding: utf-8\nso_luong = 'á'\nx = tên_khách\n"


def corpus(spark):
    rows = [(f"name{i}", 0, 0.7) for i in range(12)] + [(f"tên{i}", 1, 0.75) for i in range(5)] + [("so_luong", 3, 0.8), ("", 0, 0.7)]
    return spark.createDataFrame(rows, "id string, label int, confidence double")


def test_augment_fills_classes_and_repeats_itself(spark):
    base = corpus(spark)
    got = training.augment(base, 9)
    assert {r["label"]: r["n"] for r in training.deficits(got, 9).collect()} == {0: 13, 1: 9, 3: 9}
    assert sorted(map(str, got.collect())) == sorted(map(str, training.augment(base.repartition(3), 9).collect()))
    assert {r["id"] for r in got.where("label = 3").collect()} <= {"so_luong", "getso_luong", "setso_luong", "so_luongInfo", "so_luongData"}
    up = training.augment(base, 40).where("label = 0 and confidence < 0.7").collect()
    assert len(up) == 27 and all(r["id"].lower() in {f"name{i}" for i in range(12)} | {""} for r in up)
    assert training.augment(base.limit(0), 9).count() == 0


def test_model_is_fitted_saved_and_loaded(spark, tmp_path):
    base = training.augment(corpus(spark), 15)
    model = training.fit(base, trees=3, depth=2)
    path = str(tmp_path / "model")
    assert training.load(path) is None
    model.save(path)
    told = training.predict(base.where("id <> ''"), training.load(path))
    assert told.where("label = predicted").count() >= 0.9 * told.count()
    by_rule = {r["id"]: r["predicted"] for r in training.predict(base).collect()}
    assert (by_rule["name1"], by_rule["tên1"] in (1, 2), by_rule["so_luong"]) == (0, True, 3)
    lines = {r["label"]: r for r in training.report(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")).collect()}
    assert (lines[0]["precision"], lines[0]["recall"], lines[2]["precision"], lines[2]["recall"]) == (1.0, 0.5, None, 0.0)
    training.export_features(base, str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == 66
    training.export_unlabelled(base, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("label = -1").count() == base.where("id is not null").count()


def test_service_shapes(spark):
    files = spark.createDataFrame([("a.py", SOURCE, "Python"), ("b.py", "x = 1\n", "Python")], "file string, source string, language string")
    found = engine.lint(files).cache()
    events = service.event_stream(files, found).collect()
    assert all(e["event"].startswith("data: ") and e["event"].endswith("\n\n") for e in events)
    last = {e["file"]: json.loads(e["event"][6:]) for e in events if e["done"]}
    assert last["b.py"]["stats"] == {"errors": 0, "warnings": 0, "infos": 0} and sum(last["a.py"]["stats"].values()) == found.where("file = 'a.py'").count()
    body = {r["file"]: json.loads(r["body"]) for r in service.answers(found, files).collect()}
    assert body["b.py"]["diagnostics"] == [] and len(body["a.py"]["diagnostics"]) == found.where("file = 'a.py'").count()
    toks = tokens(files)
    service.register("mine", lambda t: run_rules(t, ["VL004"]))
    assert service.registered() == ["mine"] and service.run_added(toks).columns == OUT and service.run_added(toks).count() == 1
    assert service.unregister("mine") and not service.unregister("mine") and service.run_added(toks) is None
    assert service.load_plugins("no.such.group") == []


def test_one_pass_over_tokens(spark):
    files = spark.createDataFrame([("a.py", SOURCE, "Python")], "file string, source string, language string")
    plan = engine.lint(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_replies_and_declarations(spark):
    sent = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "id": "s", "method": "shutdown"}, {"jsonrpc": "2.0", "id": 3, "method": "none"}, {"jsonrpc": "2.0", "method": "initialized"}]
    raw = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(sent)] + [(9, "{")], "seq long, value string")
    got = {r["seq"]: json.loads(r["reply"]) for r in editor.replies(editor.messages(raw)).collect()}
    assert set(got) == {0, 1, 2, 9}
    assert got[0]["id"] == 1 and got[0]["result"]["capabilities"]["hoverProvider"] and got[1] == {"jsonrpc": "2.0", "id": "s", "result": None}
    assert got[2]["error"]["code"] == -32601 and got[9]["error"]["code"] == -32700
    rows = spark.createDataFrame([("a.cpp", "số", 1, 2, False), ("a.cpp", "b", 1, 2, False), ("s.h", "số", 1, 2, True)], "file string, name string, line int, col int, system boolean")
    assert [r["line"] for r in G.naming_check(rows).collect()] == [1]
    assert [r["grammar"] for r in G.available(G.grammar_table(spark), spark.createDataFrame([("Rust",), ("none",)], "grammar string")).collect()] == ["Rust"]
