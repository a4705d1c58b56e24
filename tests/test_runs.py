"""Stored runs, path patterns, sources of one name, broken sources, names classified once, model probabilities, and fast paths by plan."""

import re

from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans import config, engine, names, runs, service, training
from tidewright.sources import files, patterns


def test_runs_are_merged_and_deleted(spark, tmp_path):
    """Statistics equal those counted anew after inserts, repeated runs and ids, and deletes."""
    folder = str(tmp_path / "history")
    schema = "id string, project_id string, run_id string, rule_id string, severity string, created_at timestamp"
    run = "id string, project_id string, started_at timestamp, finished_at timestamp, files_count long, triggered_by string"
    made = {r: [(f"{r}-{i}", f"p{i % 2}", r, f"VL00{i % 3}", ("error", "warning", "info", "fatal")[i % 4]) for i in range(n)] for r, n in (("r1", 20), ("r2", 7), ("r3", 1))}

    def table(*which):
        rows = [x for r in which for x in made[r]]
        return spark.createDataFrame([(*x, None) for x in rows], schema).withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, length(id) * 10 + ascii(substr(id, 2)))"))

    def of_runs(*which):
        return spark.createDataFrame([(r, p, None, None, 3, None) for r in which for p in ("p0", "p1")], run)

    def check(*which):
        want = table(*which).groupBy("project_id", "rule_id").agg(F.count(F.lit(1)).alias("total_count"), F.max("created_at").alias("last_seen")).select("rule_id", "total_count", "last_seen", "project_id")
        assert sorted(map(str, runs.stored(spark, folder, "stats").collect())) == sorted(map(str, want.collect()))

    runs.store(folder, table("r1").unionByName(table("r1")), of_runs("r1"))
    check("r1")
    runs.store(folder, table("r2"), of_runs("r2"))
    runs.store(folder, table("r2"), of_runs("r2"))
    check("r1", "r2")
    runs.store(folder, table("r3"), of_runs("r3"))
    check("r1", "r2", "r3")
    got = {(r["id"], r["project_id"]): r for r in runs.stored(spark, folder, "runs").collect()}
    assert len(got) == 6 and got["r3", "p1"]["error_count"] == 0 and got["r1", "p0"]["error_count"] == 5 and got["r1", "p1"]["warning_count"] == 5 and got["r1", "p1"]["triggered_by"] == "api"
    for project in ("p0", "p1"):
        runs.delete_run(spark, folder, project, "r1")
        runs.delete_run(spark, folder, project, "none")
    check("r2", "r3")
    runs.delete_project(spark, folder, "p0")
    assert {r["project_id"] for r in runs.stored(spark, folder, "stats").collect()} == {"p1"} and {r["project_id"] for r in runs.stored(spark, folder, "runs").collect()} == {"p1"}


def test_globs():
    cases = {
        "*.py": (["a.py", "x/y/a.py"], ["a.pyc", "a.py/b"]), "src/*.py": (["src/a.py"], ["src/x/a.py", "a/src/b.py"]), "src/**/*.py": (["src/a.py", "src/x/y/a.py"], ["a.py"]), "build/": (["build/a", "build/x/a"], ["builder/a", "build"]), "/a.py": (["a.py"], ["x/a.py"]),
        "[a-c]?.{py,js}": (["ab.py", "c1.js", "d/bb.py"], ["db.py", "a.py"]), "[!a]x": (["bx"], ["ax", "/x"]), "a\\\\*b": (["a*b"], ["axb"]), "**/t/**": (["t/a", "x/t/y/z"], ["at/b"]), "x[": (["x["], ["x"]), "a.b": (["a.b"], ["axb"]), "{x": (["{x"], ["x"]),
    }
    for glob, (yes, no) in cases.items():
        r = re.compile(patterns.glob_regex(glob.replace("\\\\", "\\")))
        assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no), glob


def test_scans_read_no_other_file(spark, tmp_path):
    root = tmp_path / "a folder+1"
    for name in ("src/a.py", "src/gen_1/b.py", "lib/c.py", "src/d.txt", "src/gen_1/keep.py", "z y.py"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    found = files.source_files(spark, str(root), include=["src/**", "z y.py"], exclude=["**/gen_*/**", "!**/keep.py"])
    assert sorted(r["file"].rsplit("/", 1)[-1].replace("%20", " ") for r in found.collect()) == ["a.py", "keep.py", "z y.py"]
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numFiles").value() == 3
    assert files.source_files(spark, str(root)).count() == 5
    project = config.parse_config('[lint]\ninclude = ["src/**", "lib/{a,b}.py"]\nexclude = ["gen/"]\n')
    assert project.include == ["src/**", "lib/{a,b}.py"] and project.exclude == ["gen/"]


def test_sources_of_one_name(spark):
    """Rows that share a name, or have none, have limits, doubles and fixes of their own."""
    text = ["tên = 1\nsố = 2\nso_luong = 3\n", "á = 4\n", "so_luong = 5\n", "é = 6\n"]
    rows = spark.createDataFrame([(i, f, t, "Python") for i, (f, t) in enumerate(zip(["a.py", "a.py", None, None], text, strict=True))], "row long, file string, source string, language string")
    every = engine.lint(rows)
    few = engine.lint(rows, engine.Config(max_violations=1))
    per = lambda d: {r["row"]: r["n"] for r in d.groupBy("row").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per(few)) == {0, 1, 2, 3} and per(engine.lint(rows, engine.Config(max_violations=100))) == per(every)
    assert every.where("rule_id = 'VL003'").count() == 2 and engine.without_doubles(every).where("rule_id = 'VL003'").count() == 0
    fixed = {r["row"]: r["fixed"] for r in engine.apply_fixes(rows, every).collect()}
    assert fixed == {0: "ten = 1\nso = 2\nso_luong = 3\n", 1: "a = 4\n", 2: "so_luong = 5\n", 3: "e = 6\n"}
    single = rows.where("row in (0, 3)").drop("row")
    assert {r["file"]: r["fixed"] for r in engine.apply_fixes(single, engine.lint(single)).collect()} == {"a.py": fixed[0], None: fixed[3]}


def test_broken_sources(spark):
    rows = spark.createDataFrame([("a.py", None, "Python"), ("b.py", "tên = 1\n", "Python"), ("c.py", "x" * 100, "Python"), (None, None, None)], "file string, source string, language string")
    found = engine.lint(rows, longest=50)
    assert sorted((str(r["file"]), r["message"]) for r in found.where("rule_id = 'VL000'").collect()) == [("None", "Lexer error: source cannot be decoded"), ("a.py", "Lexer error: source cannot be decoded"), ("c.py", "Lexer error: source is too long")]
    alone = engine.lint(rows.where("file = 'b.py'"))
    assert sorted(map(str, found.where("file = 'b.py'").drop("row").collect())) == sorted(map(str, alone.drop("row").collect()))


def test_long_literals_and_files(spark):
    """Literals of a megabyte in all languages, and time in proportion to a file's length."""
    literal = '"' + '\\\\"x'.replace("\\\\", "\\") * 300_000 + '"'
    table = spark.createDataFrame([(lang, f"a = {literal}\n", lang) for lang in ("Python", "JavaScript", "Cpp")] + [("d", "#define a \\\n b" * 50_000, "Cpp")], "file string, source string, language string")
    from tidewright.operators.lexer import tokens

    got = tokens(table)
    assert got.where("kind = 'StringLiteral'").select(F.length("raw").alias("n")).distinct().collect()[0]["n"] == len(literal)
    assert got.where("file = 'd'").count() <= 3
    many = spark.createDataFrame([("m", "biến_1 = foo('a b', 12) # c\n" * 20_000, "Python")], "file string, source string, language string")
    last = tokens(many).agg(F.max("line").alias("line"), F.max("start").alias("start"), F.count(F.lit(1)).alias("n")).first()
    assert (last["line"], last["start"], last["n"]) == (20_001, 20_000 * 30, 20_000 * 9 + 1)
    points = spark.createDataFrame([("é" * 100_000,)], "s string").select(F.explode(T.code_points(F.col("s"))).alias("p")).agg(F.max("p.byte_offset").alias("x"), F.count(F.lit(1)).alias("n")).first()
    assert (points["x"], points["n"]) == (199_998, 100_000)


def test_names_are_classified_once(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "tên").when(F.col("id") % 3 == 1, F.concat(F.lit("so_luong_"), (F.col("id") % 50).cast("string"))).alias("id"), F.col("id").alias("at"))
    got = names.classify_batch(rows)
    from tidewright import api

    want = api.classify(rows.where("id is not null")).select(got.columns).unionByName(rows.where("id is null").selectExpr("id", "at", "null as class", "null as style", "null as ratio", "null as confidence"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert names.classify_batch(rows.limit(0)).count() == 0


def test_probabilities(spark, tmp_path):
    rows = [(f"name{i}", 0, 0.7) for i in range(12)] + [(f"tên{i}", 1, 0.75) for i in range(8)] + [(f"so_luong{i}", 3, 0.8) for i in range(8)]
    base = spark.createDataFrame(rows, "id string, label int, confidence double")
    model = training.fit(base, trees=3, depth=2)
    training.save(model, str(tmp_path / "m"))
    told = training.info(spark, str(tmp_path / "m"))
    assert told["classes"] == list(training.CLASSES[:4]) and len(told["features"]) == 64 and told["machines"] == 4
    got = training.probabilities(base, training.load(str(tmp_path / "m"))).collect()
    by_spark = {r["id"]: int(r["_prediction"]) for r in model.transform(training._vectors(base)).collect()}
    for r in got:
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and r["probabilities"].index(max(r["probabilities"])) == r["predicted"] == by_spark[r["id"]]
    plain = training.probabilities(base).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["probabilities"].index(max(r["probabilities"])) == r["predicted"] for r in plain)


def test_registry():
    assert service.find("VL005")["severity"] == "error" and service.find("VL999") is None
    assert service.rules_by_category("encoding") == ["VL003", "VL005"]
    before = service.registered()
    service.register("added", lambda t: t)
    assert service.added_since(before) == ["added"] and service.unregister("added")
