"""The violation history: filters, groups, top lists and pages over a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations_of(events: DataFrame) -> DataFrame:
    """The driver's events as a history: user as project, type as rule, severity by the number in props."""
    k = F.get_json_object("props", "$.k").cast("int")
    severity = F.when(k % 3 == 0, "error").when(k % 3 == 1, "warning").otherwise("info")
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("project_id"), F.concat(F.lit("src/File"), (F.col("user_id") % 97).cast("string"), F.lit(".py")).alias("file_path"),
        F.col("event_type").alias("rule_id"), severity.alias("severity"), F.col("ts").alias("created_at"),
    )


def search(v: DataFrame, project: str, rule: str | None = None, severity: str | None = None, file_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; file_like keeps its own % and _ and ignores ASCII case; 1000 rows at most."""
    rows = v.where(F.col("project_id") == project)
    for column, value in (("rule_id", rule), ("severity", severity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if file_like is not None:
        rows = rows.where(F.lower("file_path").like(f"%{file_like.lower()}%"))
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(min(limit, 1000))


def by_rule(v: DataFrame) -> DataFrame:
    return v.groupBy("rule_id").agg(F.count(F.lit(1)).alias("cnt"), F.min("severity").alias("severity"))


def by_severity(v: DataFrame) -> DataFrame:
    return v.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt"))


def top_files(v: DataFrame, n: int = 20) -> DataFrame:
    return v.groupBy("file_path").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "file_path").limit(n)


def total(v: DataFrame, project: str) -> DataFrame:
    """(total): violations of a project."""
    return v.where(F.col("project_id") == project).agg(F.count(F.lit(1)).alias("total"))


def projects(rows: DataFrame) -> DataFrame:
    """Projects (id, name, created_at), newest first."""
    return rows.orderBy(F.desc("created_at"), "id")


def insert_or_ignore(v: DataFrame, new: DataFrame) -> DataFrame:
    """v with the rows of new whose id is not there; of rows of new that share an id one goes in."""
    return v.unionByName(new.dropDuplicates(["id"]).join(v.select("id"), "id", "left_anti").select(*v.columns))


def delete_project(rows: DataFrame, v: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(projects, violations) without a project and what belongs to it."""
    return rows.where(F.col("id") != project), v.where(F.col("project_id") != project)
