"""Shapes of a service around the lint plan: event streams, replies, and rules that others add."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import engine, reports

RuleFn = Callable[[DataFrame], DataFrame]
_ADDED: dict[str, RuleFn] = {}


def register(name: str, rule: RuleFn) -> None:
    """Add a rule, tokens to findings (columns of rules.OUT); the same name replaces it."""
    _ADDED[name] = rule


def unregister(name: str) -> bool:
    return _ADDED.pop(name, None) is not None


def registered() -> list[str]:
    return sorted(_ADDED)


def load_plugins(group: str = "tidewright.rules") -> list[str]:
    """Register the rules that installed distributions offer under the group; their names."""
    from importlib.metadata import entry_points

    found = entry_points(group=group)
    for point in found:
        register(point.name, point.load())
    return sorted(p.name for p in found)


def run_added(tokens: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """Findings of added rules (all unless named); None where there are none."""
    out = [_ADDED[n](tokens) for n in names or registered()]
    return reduce(DataFrame.unionByName, out) if out else None


def counts(diagnostics: DataFrame) -> DataFrame:
    """(file, errors, warnings, infos)."""
    return diagnostics.groupBy("file").agg(
        F.count_if(F.col("severity").isin("error", "fatal")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos")
    )


def _gathered(files: DataFrame, diagnostics: DataFrame, ordered_by: tuple[str, ...]) -> DataFrame:
    """(file, l, errors, warnings, infos) of every file: its records in order and its counts, of one pass over the diagnostics."""
    row = F.struct(*ordered_by, reports.json_record().alias("r"))
    n = lambda *of: F.count_if(F.col("severity").isin(*of))
    each = diagnostics.groupBy(F.col("file").alias("_file")).agg(F.sort_array(F.collect_list(row)).alias("l"), n("error", "fatal").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return files.select("file").join(each, F.col("file").eqNullSafe(F.col("_file")), "left").drop("_file").fillna(0, ["errors", "warnings", "infos"])


def _event(text: Column) -> Column:
    return F.concat(F.lit("data: "), text, F.lit("\n\n"))


def event_stream(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(file, done, start, event): server-sent events, one a diagnostic, and one with the file's own counts when it is done.

    A client reads a file's events in order of done, start; a file without diagnostics has its last event all the same.
    """
    event = lambda done, start, text: F.struct(F.lit(done).alias("done"), start.cast("int").alias("start"), _event(text).alias("event"))
    last = F.to_json(F.struct(F.lit(True).alias("done"), F.struct("errors", "warnings", "infos").alias("stats")))
    events = F.concat(F.coalesce(F.transform("l", lambda x: event(False, x["start"], x["r"])), F.array().cast("array<struct<done: boolean, start: int, event: string>>")), F.array(event(True, F.lit(None), last)))
    return _gathered(files, diagnostics, ("start", "rule_id")).select("file", F.explode(events).alias("e")).select("file", "e.*")


def linted_events(files: DataFrame, config: engine.Config | None = None) -> DataFrame:
    """(file, done, start, event) of files (file, source, language) and what lint finds in them, as event_stream has them: a source's events where it is cut, the
    last one after them, so that none of them is gathered or joined. Sources of one name have events each."""
    fields = ("rule_id", "severity", "message", "identifier", "fixes", "line", "col", "start")

    def told(_, file: str | None, source: bytes | None, found: Iterator[engine.Found]) -> Iterator[tuple]:
        n = dict.fromkeys(engine.SEVERITIES, 0)
        for _, rule, severity, message, identifier, fixes, line, col, start, _ in found:
            n[severity] = n.get(severity, 0) + 1
            yield file, False, rule, severity, message, identifier, fixes, line, col, start, None, None, None
        yield file, True, *[None] * len(fields), n["error"] + n["fatal"], n["warning"], n["info"]

    made = "file string, done boolean, rule_id string, severity string, message string, identifier string, fixes array<string>, line int, col int, start int, errors long, warnings long, infos long"
    rows = engine.in_place(files, told, made, config)
    last = F.to_json(F.struct("done", F.struct("errors", "warnings", "infos").alias("stats")))
    return rows.select("file", "done", "start", _event(F.when(F.col("done"), last).otherwise(reports.json_record())).alias("event"))


def answers(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """(file, body): one JSON reply a file, with its diagnostics in order and its counts."""
    records = F.coalesce(F.transform("l", lambda x: x["r"]), F.array().cast("array<string>"))
    body = F.concat(F.lit('{"diagnostics":['), F.array_join(records, ","), F.lit('],"stats":'), F.to_json(F.struct("errors", "warnings", "infos")), F.lit("}"))
    return _gathered(files, diagnostics, ("line", "col", "rule_id")).select("file", body.alias("body"))


def find(rule_id: str) -> dict[str, str] | None:
    """A rule of the catalog by its id; None where there is none."""
    return next((dict(zip(("rule_id", "name", "description", "category", "severity"), r, strict=True)) for r in C.RULES if r[0] == rule_id), None)


def rules_by_category(category: str) -> list[str]:
    """Ids of the catalog's rules of a category, in its order."""
    return [r[0] for r in C.RULES if r[3] == category]


def added_since(before: list[str]) -> list[str]:
    """Rules that are registered now and were not before: what a plugin brought."""
    return sorted(set(registered()) - set(before))
