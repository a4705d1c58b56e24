"""Grammars by extension, and declarations that a parser outside has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Grammars, with the extensions of their files.
GRAMMARS = (
    ("C", "c h"),
    ("C++", "cpp cxx cc hpp hxx h++"),
    ("C#", "cs"),
    ("CSS", "css"),
    ("Go", "go"),
    ("Java", "java"),
    ("JavaScript", "js mjs cjs"),
    ("JSDoc", ""),
    ("JSON", "json jsonc"),
    ("Julia", "jl"),
    ("OCaml", "ml mli"),
    ("PHP", "php php5 phtml"),
    ("Python", "py pyw pyi"),
    ("QL", "ql qll"),
    ("Rust", "rs"),
    ("Scala", "scala sc"),
    ("TSX", "tsx"),
    ("TypeScript", "ts mts cts"),
)
#: Parts of the names of generated files.
GENERATED = (".pb.h", ".pb.cc", "generated", "moc_", "ui_", ".g.cpp")


def grammar_table(spark: SparkSession) -> DataFrame:
    """(extension, grammar); 36 rows, fit to broadcast."""
    return spark.createDataFrame([(e, g) for g, es in GRAMMARS for e in es.split()], "extension string, grammar string")


def grammar_of(path: Column) -> Column:
    """The grammar by what follows the last dot; null where there is none."""
    known = F.create_map(*[F.lit(x) for g, es in GRAMMARS for e in es.split() for x in (e, g)])
    return F.when(F.instr(path, ".") > 0, F.try_element_at(known, F.substring_index(path, ".", -1)))


def is_generated(path: Column) -> Column:
    out = F.lit(False)
    for part in GENERATED:
        out = out | (F.instr(path, part) > 0)
    return out


def declaration_findings(declarations: DataFrame, root: str = "") -> DataFrame:
    """Findings of (file, decl_kind, qualified_name, name, line, col, system): Vietnamese names of declarations.

    VL-AST-002 for mixed names, VL-AST-001 for others; system and generated files are passed over, the root goes from paths.
    """
    name, file = F.col("name"), F.col("file")
    cls = T.identifier_class(name)
    rows = declarations.where(~F.col("system") & ~is_generated(file) & T.has_vietnamese(name) & (cls != "PureASCII"))
    short = F.when(file.startswith(root), F.substring(file, len(root) + 1, 1 << 30)).otherwise(file) if root else file
    rule = F.when(cls == "MixedVietnamese", "VL-AST-002").otherwise("VL-AST-001")
    return rows.select(short.alias("file"), rule.alias("rule_id"), F.lit("warning").alias("severity"), "decl_kind", "qualified_name", name.alias("identifier"), T.ascii_name(name).alias("fix"), "line", "col")


def naming_check(declarations: DataFrame) -> DataFrame:
    """(file, line, col, message) of declarations of a main file (not system) whose names hold Vietnamese letters, whatever their class."""
    message = F.concat(F.lit("[VL-AST-001]: identifier '"), F.col("name"), F.lit("' contains Vietnamese characters. Consider using ASCII equivalents."))
    return declarations.where(~F.col("system") & T.has_vietnamese(F.col("name"))).select("file", "line", "col", message.alias("message"))


def available(grammars: DataFrame, present: DataFrame) -> DataFrame:
    """The grammars whose name is among those present (grammar)."""
    return grammars.join(present, "grammar", "left_semi").select("grammar").distinct()
