"""The corpus collector: files of repositories to labelled identifiers, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import EXTENSIONS

#: Names that are no identifiers of interest, the lengths of those that are, and the bytes from which a file is passed over.
SKIPPED = "if else for while return import from class def var let const function true false null None True False".split()
SHORTEST, LONGEST, LARGE = 2, 80, 300_000
IDENTIFIER = r"[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*"


def chosen_files(files: DataFrame, most: int, extensions: list[str] | None = None) -> DataFrame:
    """files (repo, path, source) by extension and size, the first ``most`` of each repository by path. Each task first keeps its
    own first ``most`` of a repository, so that a large one is not sorted whole."""
    ext = F.substring_index("path", ".", -1)
    small = files.where(ext.isin(extensions or EXTENSIONS) & (F.octet_length("source") < LARGE))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return small.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def wanted(name) -> F.Column:
    """Whether a name is kept: its length, not digits alone, no keyword."""
    return F.length(name).between(SHORTEST, LONGEST) & ~name.rlike("^[0-9]+$") & ~name.isin(SKIPPED)


def collect(files: DataFrame, curated: DataFrame | None = None, most: int = 200) -> DataFrame:
    """(id, label, confidence, has_vietnamese, language, source) of files (repo, path, source), curated (id, label, confidence) first.

    An identifier comes once: curated ones win, then the first by repository and path. Names are made distinct within a file and
    summed up before the shuffle.
    """
    rows = chosen_files(files, most)
    each = rows.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(IDENTIFIER), F.lit(0)))).alias("id"))
    first = each.where(wanted(F.col("id"))).groupBy("id").agg(F.min(F.struct("repo", "path")).alias("at"))
    name = F.col("id")
    found = first.select(
        "id", T.corpus_label(name).cast("int").alias("label"), T.corpus_confidence(name).alias("confidence"), T.has_exact(name).alias("has_vietnamese"),
        F.substring_index("at.path", ".", -1).alias("language"), F.concat_ws("/", "at.repo", "at.path").alias("source"),
    )
    if curated is None:
        return found
    given = curated.groupBy("id").agg(F.min_by("label", F.col("label")).alias("label"), F.max("confidence").alias("confidence"))
    given = given.select("id", "label", "confidence", T.has_exact(name).alias("has_vietnamese"), F.lit("").alias("language"), F.lit("curated").alias("source"))
    return given.unionByName(found.join(given.select("id"), "id", "left_anti"))


def collection_stats(files: DataFrame, corpus: DataFrame, most: int = 200) -> DataFrame:
    """One row: repositories and files scanned, identifiers found, Vietnamese ones among them."""
    scanned = chosen_files(files, most).agg(F.countDistinct("repo").alias("repos_scanned"), F.count(F.lit(1)).alias("files_scanned"))
    found = corpus.where("source <> 'curated'").agg(F.count(F.lit(1)).alias("identifiers_found"), F.count_if("has_vietnamese").alias("vietnamese_found"))
    return scanned.join(found, F.lit(True))


def label_counts(corpus: DataFrame) -> DataFrame:
    """(label, n) in order of labels."""
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")
