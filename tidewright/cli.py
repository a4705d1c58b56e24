"""The command line: lint, classify, detect, init and version over a local or given Spark session."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import encoding as E
from .plans import config, engine, reports
from .sources import files

VERSION = "1.0.0"


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidewright", description="Language conventions of source text.")
    modes = out.add_subparsers(dest="mode", required=True)
    lint = modes.add_parser("lint", help="diagnostics of files and folders")
    lint.add_argument("files", nargs="*", default=["."])
    lint.add_argument("--config")
    lint.add_argument("--format", choices=sorted(api.FORMATS), default="text")
    lint.add_argument("--max-violations", type=int, default=0, help="per source; counts where no configuration file is found")
    lint.add_argument("--include", action="append", default=[], help="a pattern of paths below folders")
    lint.add_argument("--exclude", action="append", default=[], help="a pattern of paths to leave out")
    lint.add_argument("--context", type=int, metavar="N", help="show source lines, with N before and after, suggestions and rules (text only)")
    lint.add_argument("--no-color", action="store_true", help="no colours where the output is a terminal")
    lint.add_argument("--fix", action="store_true", help="write fixed sources")
    lint.add_argument("--fix-style", choices=("snake", "camel"), default="snake")
    modes.add_parser("classify", help="classes of names, a name a line").add_argument("files", nargs="+")
    modes.add_parser("detect", help="encodings of files").add_argument("files", nargs="+")
    modes.add_parser("init", help="write a configuration file")
    modes.add_parser("version")
    return out


def _lint(spark: SparkSession, args) -> int:
    path = args.config or config.find_config()
    project = config.parse_config(open(path, encoding="utf-8").read()) if path else config.Project()
    if not path:  # a configuration file says how many
        project.lint.max_violations = args.max_violations
    sources = files.named_files(spark, args.files, project.include + args.include, project.exclude + args.exclude).cache()
    found = engine.without_doubles(engine.lint(sources, project.lint)).cache()
    if args.format == "text" and args.context is not None:
        shown = reports.text_reports(sources, found, True, sys.stdout.isatty() and not args.no_color, args.context)
        lines = shown.orderBy("file", "start", "rule_id").select(F.rtrim("report", F.lit("\n")).alias("out"))
    else:
        lines = found.orderBy("file", "start", "rule_id").select(api.FORMATS[args.format]().alias("out"))
    for row in lines.toLocalIterator():
        print(row["out"])
    if args.fix:
        for row in engine.apply_fixes(sources, found, args.fix_style == "camel").join(sources.select("file", "source"), "file").where("fixed <> source").toLocalIterator():
            with open(row["file"].removeprefix("file:"), "w", encoding="utf-8", newline="") as f:
                f.write(row["fixed"])
    if args.format == "text":
        print(reports.summary(sources, found).first()["text"])
    return engine.exit_code(found, sources).first()["exit_code"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.mode == "version":
        print(f"tidewright {VERSION}")
        return 0
    if args.mode == "init":
        if os.path.exists(config.FILE_NAME):
            print(f"{config.FILE_NAME} is there already", file=sys.stderr)
            return 1
        with open(config.FILE_NAME, "w", encoding="utf-8") as f:
            f.write(config.default_config())
        return 0
    spark = spark or SparkSession.builder.appName("tidewright").getOrCreate()
    if args.mode == "lint":
        return _lint(spark, args)
    if args.mode == "classify":
        for row in api.classify(files.name_lines(spark, args.files)).toLocalIterator():
            print(row["id"], row["class"], row["style"], f"{row['confidence']:.2f}")
        return 0
    raw = spark.read.format("binaryFile").load(args.files)
    for row in raw.select(E.charset_line(F.col("path"), F.col("content")).alias("out")).toLocalIterator():
        print(row["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
