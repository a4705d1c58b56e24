"""Scan runs and rule statistics: stored tables that each run's partial counts are merged into.

Below a folder: ``runs`` (scan_runs, a partition a project and run), ``partials`` (counts of a run by rule, likewise) and ``stats`` (rule_stats, a partition a
project). A run writes its own partitions and then the statistics of the projects it touched, from their partials: history is not read again. Writing a run
twice replaces its partitions, so that reruns and lost tasks change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_N = {"error_count": ("error", "fatal"), "warning_count": ("warning",), "info_count": ("info",)}


def scan_runs(violations: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, project_id, started_at, finished_at, files_count, error_count, warning_count, info_count, triggered_by) of runs (id, project_id, started_at,
    finished_at, files_count, triggered_by) with the counts of their violations; runs without any have zeros. Of violations that share an id one counts."""
    once = violations.dropDuplicates(["id"])
    counts = once.groupBy("project_id", F.col("run_id").alias("id")).agg(*[F.count_if(F.col("severity").isin(*v)).alias(k) for k, v in _N.items()])
    rows = runs.join(counts, ["project_id", "id"], "left").fillna(0, list(_N)).withColumn("triggered_by", F.coalesce("triggered_by", F.lit("api")))
    return rows.select("id", "project_id", "started_at", "finished_at", F.coalesce("files_count", F.lit(0)).alias("files_count"), *_N, "triggered_by")


def partials(violations: DataFrame) -> DataFrame:
    """(project_id, run_id, rule_id, n, last_seen) of violations (id, project_id, run_id, rule_id, created_at), of which those that share an id count once."""
    return violations.dropDuplicates(["id"]).groupBy("project_id", "run_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))


def rule_stats(parts: DataFrame) -> DataFrame:
    """(project_id, rule_id, total_count, last_seen), merged from partials."""
    return parts.groupBy("project_id", "rule_id").agg(F.sum("n").alias("total_count"), F.max("last_seen").alias("last_seen"))


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(_SCHEMAS[path.rsplit("/", 1)[-1]]).parquet(path)


_SCHEMAS = {
    "partials": "rule_id string, n long, last_seen timestamp, project_id string, run_id string",
    "stats": "rule_id string, total_count long, last_seen timestamp, project_id string",
    "runs": "started_at timestamp, finished_at timestamp, files_count long, error_count long, warning_count long, info_count long, triggered_by string, project_id string, id string",
}


def store(folder: str, violations: DataFrame, runs: DataFrame) -> None:
    """Write runs with all of their violations, and the statistics of their projects. A run that is there already is replaced."""
    spark = runs.sparkSession
    _put(scan_runs(violations, runs), f"{folder}/runs", "project_id", "id")
    _put(partials(violations.join(F.broadcast(runs.select("project_id", F.col("id").alias("run_id"))), ["project_id", "run_id"], "left_semi")), f"{folder}/partials", "project_id", "run_id")
    refresh(spark, folder, runs.select("project_id").distinct())


def refresh(spark: SparkSession, folder: str, projects: DataFrame) -> None:
    """Recompute the statistics of projects (project_id; those of a run, few) from their partials alone."""
    mine = _read(spark, f"{folder}/partials").join(F.broadcast(projects), "project_id", "left_semi")
    _put(rule_stats(mine), f"{folder}/stats", "project_id")


def delete_run(spark: SparkSession, folder: str, project: str, run: str) -> None:
    """Take a run, its counts and what they add to its project's statistics away; a run that is not there changes nothing."""
    for path in (f"runs/project_id={project}/id={run}", f"partials/project_id={project}/run_id={run}", f"stats/project_id={project}"):
        _delete(spark, f"{folder}/{path}")
    refresh(spark, folder, spark.createDataFrame([(project,)], "project_id string"))


def delete_project(spark: SparkSession, folder: str, project: str) -> None:
    for table in _SCHEMAS:
        _delete(spark, f"{folder}/{table}/project_id={project}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """runs, partials or stats as they are now."""
    names = [c.split()[0] for c in _SCHEMAS[table].split(", ")]
    return _read(spark, f"{folder}/{table}").select(*names)
