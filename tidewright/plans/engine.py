"""Sources to diagnostics: rules, configuration, limits, duplicates, statistics, fixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import constants as C
from ..operators.finds import Found, finder
from ..operators.lexer import small_batches
from ..operators.rules import BUILT_IN, find

SEVERITIES = ("info", "warning", "error", "fatal")


@dataclass
class Config:
    """rules: id -> (enabled, severity); a rule that has an entry takes that severity for all it finds."""

    rules: dict[str, tuple[bool, str]] = field(default_factory=dict)
    max_violations: int = 0
    extra_rules: tuple[str, ...] = ()

    def enabled(self) -> list[str]:
        return [r for r in (*BUILT_IN, *self.extra_rules) if self.rules.get(r, (True, ""))[0]]


def configured(found: DataFrame, config: Config) -> DataFrame:
    """Severities by the registering rule's entry, and rule names."""
    names = {r[0]: r[1] for r in C.RULES}
    given = {k: v[1] for k, v in config.rules.items() if k != "VL000"}
    mapped = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("source_rule")) if d else F.lit(None)
    return found.withColumn("severity", F.coalesce(mapped(given), F.col("severity"))).withColumn("rule_name", F.coalesce(mapped(names), F.lit("")))


def limited(found: DataFrame, most: int) -> DataFrame:
    """Rules in order of id, source by source, until one brings the source's total to ``most``: later rules are cut off. Sources are told apart by
    ``row``, so that those of one name, or of none, have a limit each."""
    if most <= 0:
        return found
    before = F.rank().over(Window.partitionBy("row").orderBy("source_rule")) - 1  # what the source's earlier rules found
    return found.withColumn("_b", before).where(F.col("_b") < most).select(*found.columns)


#: Bytes of a source that is linted at most; a longer one is told as broken.
LONGEST = 1 << 28


def broken(sources: DataFrame, longest: int = LONGEST) -> Column:
    """Why a source can't be lexed; null where it can. A source that could not be decoded is null."""
    return F.when(F.col("source").isNull(), "source cannot be decoded").when(F.octet_length("source") > longest, "source is too long")


def lint(sources: DataFrame, config: Config | None = None, longest: int = LONGEST) -> DataFrame:
    """Diagnostics of (file, source, language), with the source's ``row``: a key of the caller's if sources have that column, else a number of this run.

    Sources that are null or longer than ``longest`` give one VL000 each, whatever the configuration says, and the others are linted as ever.
    """
    config = config or Config()
    return limited(configured(find(_keyed(sources, longest), config.enabled()), config), config.max_violations)


def _keyed(sources: DataFrame, longest: int) -> DataFrame:
    keyed = sources if "row" in sources.columns else sources.withColumn("row", F.monotonically_increasing_id())
    return keyed.withColumn("_why", broken(keyed, longest)).withColumn("source", F.when(F.col("_why").isNull(), F.col("source")))


#: Bytes of texts in an Arrow batch that Python hands on, about, and rows at most.
FLUSH, ROWS = 1 << 22, 1 << 13


def in_place(sources: DataFrame, told: Callable[[object, str | None, bytes | None, Iterator[Found]], Iterator[tuple]], made: str, config: Config | None = None, longest: int = LONGEST) -> DataFrame:
    """Rows ``made`` (a schema) that ``told`` makes of each source's row, file, bytes and findings, which are those of lint, in order of tokens.

    All is one pass where sources lie: nothing is shuffled or sorted, and a task holds a batch of sources and some MB of rows. Texts of rows are strings or bytes.
    A limit of violations is lint's alone.
    """
    config = config or Config()
    if config.max_violations > 0:
        raise ValueError("a limit of violations goes by rules in order: see lint")
    small_batches(sources.sparkSession)
    whole = _keyed(sources.withColumn("_given", F.col("source")), longest)
    given = F.when(F.col("_why").isNotNull() | ~F.is_valid_utf8("_given"), F.col("_given").cast("binary"))  # else it is what is lexed
    rows = whole.select("row", "file", "language", F.make_valid_utf8("source").alias("source"), "_why", given.alias("_given"))
    rules, severities = config.enabled(), {k: v[1] for k, v in config.rules.items()}
    schema = to_arrow_schema(StructType.fromDDL(made))

    def each(batches):
        found = finder(rules, severities)
        for batch in batches:
            row, file, why, given = (batch.column(c).to_pylist() for c in ("row", "file", "_why", "_given"))
            texts = batch.column("source")
            for i, f in enumerate(found(texts, batch.column("language"), why)):
                source = texts[i].as_py() if given[i] is None else None
                yield from told(row[i], file[i], given[i] if source is None else source.encode(), f)

    return rows.mapInArrow(lambda batches: batched(each(batches), schema), made)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of a bounded size; texts that are not valid UTF-8 stay as they are."""
    held, size = [], 0

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        return pa.array(values, pa.binary()).view(kind) if kind == pa.string() else pa.array(values, kind)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum([len(x) for x in r if isinstance(x, bytes | str)])
        if size >= FLUSH or len(held) >= ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def without_doubles(diagnostics: DataFrame) -> DataFrame:
    """Drop VL003 where a VL004 of the same source starts at the same place."""
    there = F.max(F.col("rule_id") == "VL004").over(Window.partitionBy("row", "start"))
    return diagnostics.withColumn("_there", there).where(~((F.col("rule_id") == "VL003") & F.col("_there"))).select(*diagnostics.columns)


def stats(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(
        F.count_if(F.col("severity").isin("error", "fatal")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"),
    )


def exit_code(diagnostics: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """2 for errors, 1 for warnings, else 0; 3 where ``files`` is given and has no row."""
    if files is not None and files.isEmpty():
        return diagnostics.sparkSession.sql("SELECT 3 AS exit_code")
    rank = F.when(F.col("severity").isin("error", "fatal"), 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return diagnostics.agg(F.coalesce(F.max(rank), F.lit(0)).alias("exit_code"))


def apply_fixes(sources: DataFrame, diagnostics: DataFrame, camel: bool = False) -> DataFrame:
    """(file, fixed), and row if sources have it: one fix a place (the least rule id), spliced into the source's bytes from left to right.

    Sources and diagnostics are matched by ``row`` where sources have that column (lint keeps it), so that sources of one name are fixed apart; else by
    name, null being one, and names must tell the sources apart.
    """
    by = ["row"] if "row" in sources.columns else ["file"]
    one = Window.partitionBy(*by, "start").orderBy("rule_id", "end")
    fixable = diagnostics.where((F.size("fixes") > 0) & (F.col("start") < F.col("end")))
    fix = F.when(F.lit(camel) & (F.size("fixes") > 1), F.get("fixes", F.lit(1))).otherwise(F.get("fixes", F.lit(0)))
    chosen = fixable.withColumn("_n", F.row_number().over(one)).where("_n = 1").groupBy(F.col(by[0]).alias("_by")).agg(F.sort_array(F.collect_list(F.struct("start", "end", fix.alias("fix")))).alias("edits"))
    small_batches(sources.sparkSession)

    @F.arrow_udf("string")
    def spliced(sources: pa.Array, edits: pa.Array) -> pa.Array:
        return _spliced(sources, edits)

    joined = sources.join(chosen, F.col(by[0]).eqNullSafe(F.col("_by")), "left")
    return joined.select(*dict.fromkeys((*by, "file")), F.when(F.col("edits").isNull(), F.col("source")).otherwise(spliced(F.make_valid_utf8(F.when(F.col("edits").isNotNull(), F.col("source"))), "edits")).alias("fixed"))


def _spliced(sources: pa.Array, edits: pa.Array) -> pa.Array:
    """Sources with (start, end, fix) put into their bytes in order; one that starts before the last one's end is left out."""

    def one(source: str | None, edits: list | None) -> str | None:
        if source is None or edits is None:
            return None
        return _put(source.encode(), [(e["start"], e["end"], e["fix"]) for e in edits]).decode(errors="replace")

    return pa.array([one(s.as_py(), e.as_py()) for s, e in zip(sources, edits, strict=True)], pa.string())


def _put(raw: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    at, out = 0, []
    for start, end, fix in edits:
        if start >= at:
            out += [raw[at:start], fix.encode()]
            at = end
    return b"".join([*out, raw[at:]])


def linted_fixes(sources: DataFrame, config: Config | None = None, camel: bool = False) -> DataFrame:
    """(row, file, fixed) of sources (file, source, language) with what lint finds in them, as apply_fixes has them; ``row`` is a number of this run where sources
    have none. A source is put together where it is cut, so that no source or edit goes to a join."""

    def told(row: object, file: str | None, source: bytes | None, found: Iterator[Found]) -> Iterator[tuple]:
        best: dict[int, tuple[str, int, str]] = {}
        for _, rule, _, _, _, fixes, _, _, start, end in found:
            if fixes and start < end:
                one = rule, end, fixes[1 if camel and len(fixes) > 1 else 0]
                if start not in best or one[:2] < best[start][:2]:
                    best[start] = one
        if source is not None and best:
            source = _put(source.decode(errors="replace").encode(), [(start, best[start][1], best[start][2]) for start in sorted(best)]).decode(errors="replace").encode()
        yield row, file, source

    kind = dict(sources.dtypes).get("row", "bigint")
    return in_place(sources, told, f"row {kind}, file string, fixed string", config)


def text_line() -> Column:
    """file:line:col: severity [RULE] message"""
    return F.format_string("%s:%d:%d: %s [%s] %s", "file", "line", "col", "severity", "rule_id", "message")


def github_line() -> Column:
    level = F.when(F.col("severity").isin("error", "fatal"), "error").otherwise("warning")
    return F.format_string("::%s file=%s,line=%d,col=%d::[%s] %s", level, F.col("file"), F.col("line"), F.col("col"), F.col("rule_id"), F.col("message"))
