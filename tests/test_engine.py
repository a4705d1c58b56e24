"""Literal inputs with known outcomes, and every query with SQL against DuckDB at the smallest size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.functions import features as M
from tidewright.functions import text as T
from tidewright.operators import encoding as E
from tidewright.operators.lexer import tokens
from tidewright.plans import engine
from tidewright.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_classes_and_styles(spark):
    ids = ["getUserInfo", "tênKhách", "ten_khach_hang", "ten", "QLKH", "MA", "tinhTong"]
    assert column(spark, ids, T.identifier_class) == ["PureASCII", "MixedVietnamese", "TransliteratedViet", "TransliteratedViet", "Abbreviation", "Abbreviation", "PureASCII"]
    names = ["snake_case", "camelCase", "PascalCase", "SCREAMING_SNAKE", "kebab-case", "x", "__", "foo", ""]
    assert column(spark, names, T.naming_style) == ["SnakeCase", "CamelCase", "PascalCase", "ScreamingSnake", "KebabCase", "SingleLetter", "ScreamingSnake", "Unknown", "Unknown"]
    assert column(spark, ["tên", "bácSĩ"], T.ascii_name) == ["ten", "bacS?"]


def kinds(spark, source, language="Python"):
    rows = spark.createDataFrame([("f", source, language)], "file string, source string, language string")
    return [(r["kind"], r["raw"], r["line"], r["col"]) for r in tokens(rows).orderBy("pos").collect()]


def test_tokens(spark):
    assert kinds(spark, "") == [("EndOfFile", "", 1, 1)]
    got = kinds(spark, "tênKhách = 'John'\nif x:\n  return None")
    assert got[0] == ("MixedIdentifier", "tênKhách", 1, 1) and got[2] == ("StringLiteral", "'John'", 1, 14)
    assert [g for g in got if g[0] == "Keyword"] == [("Keyword", "if", 2, 1), ("Keyword", "return", 3, 3), ("Keyword", "None", 3, 10)]
    assert kinds(spark, "/* Quản lý */ let x", "JavaScript")[0][0] == "VietnameseComment"
    assert kinds(spark, 'x = """open', "Python")[2][0] == "BlockComment"


def found(spark, source, language="Python"):
    rows = spark.createDataFrame([("f", source, language)], "file string, source string, language string")
    return {r["source_rule"] for r in engine.lint(rows).collect()}


def test_rules(spark):
    assert "VL009" in found(spark, 'raise ValueError("lỗi")') and "VL009" not in found(spark, 'throw new Error("lỗi")', "JavaScript")
    assert {"VL011", "VL001", "VL004"} <= found(spark, "import numpy as ten")
    late = "\n" * 8 + "x = 1"
    assert "VL010" in found(spark, 'def so_luong():\n  """English."""' + late)
    assert "VL010" not in found(spark, "def so_luong():\n  'English.'" + late)
    assert "VL005" in found(spark, "def a\u0301(): pass")
    assert "VL008" in found(spark, "so_luong danhSach")
    assert found(spark, "def clean(a):\n    return a") == set()


def test_fixes_and_encodings(spark):
    rows = spark.createDataFrame([("f", "tên = 'é'\nb = tên", "Python")], "file string, source string, language string")
    assert engine.apply_fixes(rows, engine.lint(rows)).first()["fixed"] == "ten = 'é'\nb = ten"
    raw = spark.createDataFrame([(0, bytearray(b"")), (1, bytearray(b"Hello")), (2, bytearray("Việt Nam ơi".encode())), (3, bytearray(b"\xef\xbb\xbfHello"))], "i int, c binary")
    got = [r["d"]["encoding"] for r in raw.select("i", E.detect(F.col("c")).alias("d")).orderBy("i").collect()]
    assert got == ["us-ascii", "us-ascii", "utf-8", "utf-8-sig"]


def test_features(spark):
    a, b, c = column(spark, ["getUserById", "tênKhách", ""], M.features)
    assert len(a) == len(b) == len(c) == 64
    assert a[0] == a[1] == a[6] == 0 and a[2] == 1 and a[10] == 1
    assert b[0] > 0 and b[1] > 0 and b[6] == 1 and abs(sum(a[28:44]) - 1) < 1e-6


@pytest.mark.parametrize("name", ["c05_lint_counts", "f14_classify", "l02_tokens_python", "a06_top_files"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect())
