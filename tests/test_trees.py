"""Trees to tokens against a walk by hand, the choice between trees and the built-in lexer, and declarations of C++ sources."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import grammars as G
from tidewright.functions.arrays import running
from tidewright.operators.declarations import declarations
from tidewright.operators.lexer import tokens
from tidewright.operators.trees import NODE_TYPES, numbered, unified_tokens, walked

NODES = "file string, node long, depth int, type string, named boolean, start int, end int, row int, column int"


def test_running_sums_of_any_length(spark):
    for n in (0, 1, 15, 16, 17, 1023, 1024, 1025, 3000):
        rows = spark.range(1).select(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>").alias("a") if n < 20 else F.sequence(F.lit(0), F.lit(n - 1)).alias("a"))
        step = lambda at, x: (F.when(x % 3 == 0, at["sum"]), {"sum": at["sum"] + x})
        want = [i * (i - 1) // 2 for i in range(n) if i % 3 == 0]
        for after in (None, lambda at, part: {"sum": at["sum"] + F.aggregate(part, F.lit(0), lambda a, b: a + b)}):
            assert rows.select(running(F.col("a"), "int", {"sum": (F.lit(0), "int")}, step, after).alias("r")).first()["r"] == want
    assert spark.range(1).select(running(F.lit(None).cast("array<int>"), "int", {"k": (F.lit(0), "int")}, lambda at, x: (x, {"k": at["k"]})).alias("r")).first()["r"] == []


def made_tree(rng, file, size):
    """A random tree of intervals and its tokens by a recursive walk."""
    kinds = ["identifier", "comment", "string", "module", "block", "def", "+"]
    rows, want = [], []

    def grow(start, end, depth, hidden):
        kind = rng.choice(kinds) if depth else "module"
        rows.append((file, len(rows), depth, kind, kind not in ("def", "+"), start, end, 0, start))
        whole = kind in ("comment", "string") and end > start
        children = depth < 1 or (end - start > 1 and rng.random() < 0.6)
        if whole or (kind in ("identifier", "def") and not children and end > start):
            if not hidden:
                want.append((start, end, {"identifier": "Identifier", "comment": "Comment", "string": "StringLiteral", "def": "Keyword"}[kind]))
        if children:
            at = start
            while at < end:
                to = rng.randint(at, end) if rng.random() < 0.9 else end
                grow(at, to, depth + 1, hidden or whole)
                if to == at and rng.random() < 0.5:
                    at += 1
                at = max(at, to)

    grow(0, size, 0, False)
    return rows, want


def test_walk_by_windows(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        r, w = made_tree(rng, f"f{i}.py", rng.randint(1, 25))
        rows, want[f"f{i}.py"] = rows + r, w
    got = walked(spark.createDataFrame(rows, NODES).repartition(5)).collect()
    assert {r["file"]: [(t["start"], t["end"], t["kind"]) for t in r["tree"]] for r in got} == want


def test_deep_trees(spark):
    """10,000 levels, also by intervals alone."""
    n = 10_000
    rows = [("f.py", i, i, "block", True, i, 2 * n - i + 1, 0, i) for i in range(n)] + [("f.py", n, n, "identifier", True, n, n + 1, 0, n), ("f.py", n + 1, n, "identifier", True, n + 1, n + 1, 0, n)]
    nodes = spark.createDataFrame(rows, NODES)
    for table in (nodes, numbered(nodes.drop("node")), nodes.drop("depth")):
        (got,) = walked(table).collect()
        assert [(t["start"], t["end"], t["kind"]) for t in got["tree"]] == [(n, n + 1, "Identifier")]


def test_unified_tokens(spark):
    source = "tên = 'x' # chú\nab é\n"
    nodes = [
        ("a.py", 0, 0, "module", True, 0, 26, 0, 0), ("a.py", 1, 1, "identifier", True, 0, 4, 0, 0), ("a.py", 2, 1, "=", False, 5, 6, 0, 5), ("a.py", 3, 1, "string", True, 7, 10, 0, 7), ("a.py", 4, 2, "identifier", True, 8, 9, 0, 8),
        ("a.py", 5, 1, "comment", True, 11, 17, 0, 11), ("a.py", 6, 1, "identifier", True, 18, 20, 1, 0), ("a.py", 7, 1, "identifier", True, 21, 23, 1, 3),
        ("empty.py", 0, 0, "module", True, 0, 1, 0, 0), ("none.zzz", 0, 0, "identifier", True, 0, 1, 0, 0), (None, 0, 0, "identifier", True, 0, 1, 0, 0),
    ]
    sources = [(f, source, "Python") for f in ("a.py", "a.py", "b.py", "empty.py", "none.zzz", None)] + [("c.py", None, "Python")]
    table = spark.createDataFrame(sources, "file string, source string, language string")
    got = unified_tokens(table, spark.createDataFrame(nodes, NODES))
    found = {}
    for r in got.collect():
        found.setdefault((r["file"], r["row"]), []).append((r["pos"], r["kind"], r["raw"], r["start"], r["end"], r["line"], r["col"], r["has_vietnamese"]))
    tree = [(0, "MixedIdentifier", "tên", 0, 4, 1, 1, True), (1, "StringLiteral", "'x'", 7, 10, 1, 8, False), (2, "VietnameseComment", "# chú", 11, 17, 1, 12, True), (3, "Identifier", "ab", 18, 20, 2, 1, False), (4, "VietnameseIdentifier", "é", 21, 23, 2, 4, True)]
    plain = [tuple(r[c] for c in ("pos", "kind", "raw", "start", "end", "line", "col", "has_vietnamese")) for r in tokens(table.where("file = 'b.py'")).collect()]
    by_file = {}
    for (file, _), rows in found.items():
        by_file.setdefault(file, []).append(sorted(rows))
    assert by_file["a.py"] == [tree, tree] and "empty.py" not in by_file
    assert by_file["b.py"] == by_file["none.zzz"] == by_file[None] == [sorted(plain)] and len(by_file["c.py"][0]) == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and sum(len(n.split()) for _, x, y in [] for n in (x, y)) == 0 and len(NODE_TYPES) == 17


CODE = """
#include <map>
namespace kho { namespace a::b {
class Hàng : public Base { // lớp
 public:
  Hàng(int số, const std::map<int, char>& mã = {});
  ~Hàng();
  static int đếm;
  int tên, *p = nullptr, m[3];
  bool operator==(const Hàng& x) const { int y = 1; return true; }
  enum class Màu { đỏ = 1, xanh };
  std::map<std::string, int> bảng{};
};
typedef struct { int x; } Điểm;
struct { int z; } g, h;
enum { A, B = f(1, 2), };
using Tên = std::string;
typedef int (*hàm)(int);
union U;
}}
template <typename T> T lớn(T a, T b = g(1, 2)) {
  for (int i = 0; i < 3; i++) { int k{i}; if (k) continue; }
  auto f = [](int q) { return q; };
  return a > b ? a : b;
}
int kho::a::b::Hàng::tính() const noexcept;
extern "C" { void gọi(void); }
extern "C" int một;
const char* s = "int không;";
"""
WANT = [
    ("namespace", "kho"), ("namespace", "kho::a::b"), ("class", "kho::a::b::Hàng"), ("function", "kho::a::b::Hàng::Hàng"), ("parameter", "số"), ("parameter", "mã"), ("function", "kho::a::b::Hàng::~Hàng"), ("variable", "kho::a::b::Hàng::đếm"),
    ("field", "kho::a::b::Hàng::tên"), ("field", "kho::a::b::Hàng::p"), ("field", "kho::a::b::Hàng::m"), ("variable", "y"), ("enum", "kho::a::b::Hàng::Màu"), ("enumerator", "kho::a::b::Hàng::Màu::đỏ"), ("enumerator", "kho::a::b::Hàng::Màu::xanh"),
    ("field", "kho::a::b::Hàng::bảng"), ("field", "kho::a::b::x"), ("typedef", "kho::a::b::Điểm"), ("field", "kho::a::b::z"), ("variable", "kho::a::b::g"), ("variable", "kho::a::b::h"), ("enumerator", "kho::a::b::A"), ("enumerator", "kho::a::b::B"),
    ("typedef", "kho::a::b::Tên"), ("typedef", "kho::a::b::hàm"), ("union", "kho::a::b::U"), ("function", "lớn"), ("parameter", "a"), ("parameter", "b"), ("variable", "i"), ("variable", "k"), ("variable", "f"),
    ("function", "kho::a::b::Hàng::tính"), ("function", "gọi"), ("variable", "một"), ("variable", "s"),
]


def test_declarations(spark):
    table = spark.createDataFrame([("x.cpp", CODE), ("x.cpp", CODE), (None, "int á;"), ("e.cpp", None), ("/usr/include/v.h", "struct Số { int số; };")], "file string, source string")
    per = {}
    for r in declarations(table).collect():
        per.setdefault((r["file"], r["row"]), []).append(r)
    for (file, _), rows in per.items():
        if file == "x.cpp":
            assert [(r["decl_kind"], r["qualified_name"]) for r in rows if r["name"] != "q"] == WANT
            for r in rows:
                assert CODE.split("\n")[r["line"] - 1].encode()[r["col"] - 1 :].decode().startswith(r["name"].lstrip("~")), r
        elif file is None:
            assert [(r["decl_kind"], r["qualified_name"], r["system"]) for r in rows] == [("variable", "á", False)]
        else:
            assert file != "e.cpp" and [(r["decl_kind"], r["qualified_name"], r["system"]) for r in rows] == [("struct", "Số", True), ("field", "Số::số", True)]
    assert len(per) == 4
    found = G.declaration_findings(declarations(table.where("file = 'x.cpp'").limit(1))).select("rule_id", "identifier", "fix").collect()
    assert ("VL-AST-002", "Hàng", "hang") in [tuple(map(str, (r[0], r[1], r[2].lower()))) for r in found]


@pytest.mark.parametrize("n", [1, 400])
def test_declarations_of_long_and_deep_sources(spark, n):
    code = "".join(f"namespace n{i} {{ " for i in range(30)) + "".join(f"int a{i} = {{1, 2}}; void f{i}(int x) {{ g(); }}\n" for i in range(n)) + "}" * 30
    got = declarations(spark.createDataFrame([("d.cpp", code)], "file string, source string")).groupBy("decl_kind").count().collect()
    assert dict(map(tuple, got)) == {"namespace": 30, "variable": n, "function": n, "parameter": n}
    deepest = declarations(spark.createDataFrame([("d.cpp", code)], "file string, source string")).where("name = 'a0'").first()
    assert deepest["qualified_name"] == "::".join(f"n{i}" for i in range(30)) + "::a0"
