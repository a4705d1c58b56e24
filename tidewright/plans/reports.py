"""Diagnostics as reports: a record a diagnostic, made in place, and one document a file.

Records are built where the diagnostics are. Documents are gathered a file each, as a
file's diagnostics are bounded by its tokens; a report of a whole run is the records,
written as lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import engine

TOOL = "tidewright"
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
#: Order of diagnostics in documents.
ORDER = ("start", "rule_id", "end")


def is_error() -> Column:
    return F.col("severity").isin("error", "fatal")


def json_record() -> Column:
    return F.to_json(F.struct("file", F.col("rule_id").alias("rule"), "severity", "message", "line", "col", "identifier", "fixes"))


def sarif_result() -> Column:
    level = F.when(is_error(), "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))


def sarif_document(results: Column, version: str = "1.0.0") -> Column:
    """The whole document around an array of results."""
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(version).alias("version"), F.array().cast("array<string>").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    return F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs")))


def editor_range() -> Column:
    """Lines and bytes from 0; the end is the name's bytes after the start."""
    line, at = F.greatest(F.col("line") - 1, F.lit(0)), F.greatest(F.col("col") - 1, F.lit(0))
    place = lambda x: F.struct(line.alias("line"), x.alias("character"))
    return F.struct(place(at).alias("start"), place(at + F.octet_length("identifier")).alias("end"))


def editor_record() -> Column:
    code = F.when(is_error(), 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return F.struct(editor_range().alias("range"), code.alias("severity"), F.col("rule_id").alias("code"), F.lit(TOOL).alias("source"), "message")


def gcc_line() -> Column:
    level = F.when(is_error(), "error").otherwise("warning")
    return F.format_string("%s:%d:%d: %s: %s [%s]", F.col("file"), F.col("line"), F.col("col"), level, F.col("message"), F.col("rule_id"))


def by_file(diagnostics: DataFrame, record: Column) -> DataFrame:
    """(file, records): each file's records in the order of ORDER."""
    placed = F.struct(*[F.col(c) for c in ORDER], F.monotonically_increasing_id().alias("_i"), record.alias("r"))
    rows = diagnostics.select("file", placed.alias("p"))
    return rows.groupBy("file").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["r"]).alias("records"))


def json_documents(diagnostics: DataFrame) -> DataFrame:
    """(file, report): a JSON array a file."""
    return by_file(diagnostics, json_record()).select("file", F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("report"))


def sarif_documents(diagnostics: DataFrame) -> DataFrame:
    return by_file(diagnostics, sarif_result()).select("file", sarif_document(F.col("records")).alias("report"))


def summary(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: files, errors, warnings, infos, and the text of the end of a run."""
    counted = diagnostics.agg(F.count_if(is_error()).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"))
    both = files.agg(F.count(F.lit(1)).alias("files")).join(counted, F.lit(True))
    said = F.concat_ws(
        "\n",
        F.format_string("Files scanned: %d", "files"),
        *[F.when(F.col(c) > 0, F.format_string(f"{c.capitalize()}: %d", c)) for c in ("errors", "warnings", "infos")],
        F.when((F.col("errors") == 0) & (F.col("warnings") == 0), "No violations found"),
    )
    return both.withColumn("text", said)


#: Where rules are described.
BASE_URL = "https://tidewright.invalid/rules/"


#: Terminal codes of the report's parts.
STYLES = {"red": 31, "green": 32, "yellow": 33, "cyan": 36, "bold": 1, "dim": 2}


def text_report(source: bool = True, url: bool = False, color: bool = False, context: int = 0) -> Column:
    """The line of a diagnostic, its source line (column ``_text``, null if there is none) with a caret and ``context`` lines before and after it
    (arrays ``_before`` and ``_after``), its suggestions, and where its rule is described; with terminal colours if asked."""
    style = lambda name, *parts: F.concat(F.lit(f"\x1b[{STYLES[name]}m"), *parts, F.lit("\x1b[0m")) if color else F.concat(*parts)
    level = F.when(is_error(), style("red", F.lit("error"))).when(F.col("severity") == "warning", style("yellow", F.lit("warning"))).otherwise(style("cyan", F.lit("info"))) if color else F.col("severity")
    place = style("bold", F.format_string("%s:%d:%d: ", "file", "line", "col"))
    head = F.concat(place, level, F.lit(" "), style("dim", F.lit("["), F.col("rule_id"), F.lit("]")), F.lit(": "), F.col("message"), F.lit("\n"))
    quoted = lambda text: style("dim", F.lit("    | "), text, F.lit("\n"))
    caret = F.when(F.col("col") > 0, F.concat(F.lit("    | "), F.repeat(F.lit(" "), F.col("col") - 1), style("green", F.lit("^")), F.lit("\n"))).otherwise("")
    around = lambda c: [F.array_join(F.transform(c, quoted), "")] if context else []
    excerpt = F.when(F.col("_text").isNotNull(), F.concat(*around("_before"), quoted(F.col("_text")), caret, *around("_after"))).otherwise("")
    fixes = F.when(F.size("fixes") > 0, F.concat(style("cyan", F.lit("    suggestion: "), F.array_join("fixes", " or ")), F.lit("\n"))).otherwise("")
    return F.concat(head, *([excerpt] if source else []), fixes, *([style("dim", F.lit("    see: " + BASE_URL), F.col("rule_id"), F.lit("\n"))] if url else []))


def text_reports(files: DataFrame, diagnostics: DataFrame, url: bool = False, color: bool = False, context: int = 0) -> DataFrame:
    """(file, start, rule_id, report) of diagnostics with their files' (file, source) lines. A line past the end shows the first one, without context.

    Sources are split once and joined line by line, so that a diagnostic meets its own lines alone. Sources of one name are told apart by their place in
    ``files``, which has to come out alike when it is read again.
    """
    split = files.select("file", F.coalesce("source", F.lit("")).alias("_s"), F.monotonically_increasing_id().alias("_source"))
    split = split.select(F.col("file").alias("_file"), "_source", (F.col("_s") == "").alias("_none"), F.split("_s", "\n").alias("_lines"))
    part = lambda first, n: F.slice("_lines", first, n)
    line = lambda text, i: F.struct(
        (i + 1).alias("at"), text.alias("text"), part(F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context))).alias("before"), part(i + 2, F.lit(context)).alias("after")
    )
    none = F.array().cast("array<string>")
    past = F.struct(F.lit(0).alias("at"), F.get("_lines", F.lit(0)).alias("text"), none.alias("before"), none.alias("after"))  # what a line past the end shows
    lines = split.select("_file", "_source", "_none", F.explode(F.concat(F.array(past), F.transform("_lines", line))).alias("l"))
    sizes = split.select(F.col("_file").alias("file"), "_source", F.size("_lines").alias("_n"))
    rows = diagnostics.join(sizes, "file").withColumn("_at", F.when(F.col("line").between(1, F.col("_n")), F.col("line")).otherwise(0)).withColumnRenamed("_source", "_of")
    rows = rows.join(lines, (F.col("file") == F.col("_file")) & (F.col("_of") == F.col("_source")) & (F.col("_at") == F.col("l.at")))
    shown = F.when(~F.col("_none") & (F.col("line") > 0), F.col("l.text"))
    rows = rows.withColumns({"_text": shown, "_before": F.col("l.before"), "_after": F.col("l.after")})
    return rows.select("file", "start", "rule_id", text_report(url=url, color=color, context=context).alias("report"))


def linted_reports(files: DataFrame, config: engine.Config | None = None, url: bool = False, color: bool = False, context: int = 0, digest: bool = False) -> DataFrame:
    """(file, start, rule_id, report) of what lint finds in files (file, source, language), as text_reports has them; with ``digest`` their MD5 alone.

    Reports are put together where their source lies, which is split into lines once, and nothing is shuffled.
    """
    style = lambda name: f"\x1b[{STYLES[name]}m" if color else ""
    off = "\x1b[0m" if color else ""
    levels = {"warning": "yellow", "info": "cyan", "error": "red", "fatal": "red"}
    said = {"fatal": "error"} if color else {}
    dim, end, caret = (style("dim") + "    | ").encode(), ("\n" + off).encode(), (style("green") + "^" + off + "\n").encode()
    quoted = lambda lines: b"".join([dim + x + end for x in lines])

    def told(_, file: str | None, source: bytes | None, found: Iterator[engine.Found]) -> Iterator[tuple]:
        lines, here, above, below = source.split(b"\n") if source else [], None, b"", b""
        name = "null" if file is None else file
        for _, rule, severity, message, _, fixes, line, col, start, _ in found:
            if line != here:
                here, above, below = line, b"", b""
                if line > len(lines):
                    above = quoted(lines[:1])
                elif line > 0:
                    above, below = quoted(lines[max(line - 1 - context, 0) : line]), quoted(lines[line : line + context])
            head = f"{style('bold')}{name}:{line}:{col}: {off}{style(levels.get(severity, 'cyan'))}{said.get(severity, severity)}{off} {style('dim')}[{rule}]{off}: {message}\n"
            tail = f"{style('cyan')}    suggestion: {' or '.join(fixes)}{off}\n" if fixes else ""
            if url:
                tail += f"{style('dim')}    see: {BASE_URL}{rule}\n{off}"
            parts = (head.encode(), above, b"    | " + b" " * (col - 1) + caret if above and col > 0 else b"", below, tail.encode())
            yield file, start, rule, _md5(parts) if digest else b"".join(parts)

    return engine.in_place(files, told, "file string, start int, rule_id string, report string", config)


def _md5(parts: tuple[bytes, ...]) -> str:
    out = hashlib.md5()
    for p in parts:
        out.update(p)
    return out.hexdigest()
