"""Names that repeat: each is classified once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api

#: A name of more than one of so many rows is hot: fewer than HOT names can be, and their classes are broadcast.
HOT = 1024


def classify_batch(names: DataFrame) -> DataFrame:
    """names (id, ...) with class, style, ratio and confidence, as api.classify gives them, each distinct name classified once.

    Rows of hot names stay where they are and take their class from a broadcast of fewer than HOT names; the others meet theirs by a shuffle. Null names have no class.
    """
    counts = names.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    every = counts.agg(F.sum("_n").alias("_all"))
    told = api.classify(counts)
    hot = told.join(F.broadcast(every), F.lit(True)).where(F.col("_n") * HOT > F.col("_all")).drop("_n", "_all")
    rest = told.drop("_n")
    known = F.broadcast(hot)
    return names.join(known, "id").unionByName(names.join(F.broadcast(hot.select("id")), "id", "left_anti").join(rest, "id", "left"))
