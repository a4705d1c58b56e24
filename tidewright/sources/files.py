"""Files as sources: trees of source files, lines of names, labelled corpora."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..operators import encoding as E
from .patterns import selected

#: Extensions that a scan of a folder keeps.
EXTENSIONS = "py js mjs cjs ts tsx jsx c h cpp cc cxx hpp hxx".split()


def spread(table: DataFrame) -> DataFrame:
    """The table, its rows dealt to all cores if it has fewer files than they are: a small file is read by one task, and what follows
    runs where rows are read. Tables of many files stay where they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def source_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(file, source, language, encoding) of every file below a folder that its extension, include and exclude (see patterns.selected; paths from the
    folder on) take, bytes detected and converted.

    Paths are held against them when files are listed, so that no byte of another file is read. Bytes in an encoding without a conversion give a null source.
    """
    kept = "|".join(extensions or EXTENSIONS)
    path = F.col("_metadata.file_path")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().toString().rstrip("/") + "/"
    scheme = "^[a-z0-9+.-]+:/*"  # written with one slash or three
    bare = F.regexp_replace(path, scheme, "")
    below = F.url_decode(F.replace(F.substring(bare, F.lit(len(re.sub(scheme, "", full)) + 1), F.length(bare)), F.lit("+"), F.lit("%2B")))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(path.rlike(rf"\.({kept})$"))
    if include or exclude:
        raw = raw.where(selected(below, include, exclude))
    found = raw.select("path", "content", E.detect(F.col("content"))["encoding"].alias("encoding"))
    return found.select(F.col("path").alias("file"), E.normalize(F.col("content"), F.col("encoding")).alias("source"), language_of(F.col("path")).alias("language"), "encoding")


def named_files(spark: SparkSession, paths: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(file, source, language, encoding) of named files, whatever their extension, and of source files below folders that the patterns take; each once.
    Paths that aren't there are told in a warning and passed over."""
    import warnings

    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    settings, folders, single = spark._jsc.hadoopConfiguration(), [], []
    for path in sorted(set(paths)):
        store = fs(path).getFileSystem(settings)
        if not store.exists(fs(path)):
            warnings.warn(f"no such file: {path}", stacklevel=2)
        else:
            (folders if store.getFileStatus(fs(path)).isDirectory() else single).append(path)
    parts = [source_files(spark, folder, None, include, exclude) for folder in folders]
    if single:
        raw = spark.read.format("binaryFile").load(single).select("path", "content", E.detect(F.col("content"))["encoding"].alias("encoding"))
        parts.append(raw.select(F.col("path").alias("file"), E.normalize(F.col("content"), F.col("encoding")).alias("source"), language_of(F.col("path")).alias("language"), "encoding"))
    if not parts:
        return spark.createDataFrame([], "file string, source string, language string, encoding string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["file"]) if len(parts) > 1 else out


def request_bodies(lines: DataFrame) -> DataFrame:
    """(file, source, language) of requests, JSON with source and filename (``input.py`` without one) a line (value); no source, no row."""
    r = F.from_json("value", "source string, filename string")
    rows = lines.select(r.alias("r")).where("r.source is not null").select(F.coalesce("r.filename", F.lit("input.py")).alias("file"), F.col("r.source").alias("source"))
    return rows.withColumn("language", language_of(F.col("file")))


def name_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id): a name a line, empty lines passed over."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("id"))


def labelled_corpus(lines: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """(id, label, confidence) of JSON lines (value): comments, blanks and rows without id or label go, as do labels but 0 to 5; no confidence is 1."""
    row = F.from_json("value", "id string, label int, confidence double")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(row.alias("r")).select("r.*")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return rows.where(F.col("id").isNotNull() & F.col("label").between(0, 5) & (F.col("confidence") >= least_confidence))
