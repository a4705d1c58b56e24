"""What several operators share: checkpoints, gapless ranks, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sub-buckets of each key in gapless_rank; fixed, so ranks don't depend on the cluster.
SALTS = 1024

#: Copies of a row that one task makes at once in gapless_rank.
COPIES = 4096

#: Arrow batches hold at most so many rows, as one row may be a very long text.
ARROW_ROWS = 512

#: Texts become Python strings until they hold so many UTF-8 bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: What worker processes remember between tasks: name -> how it is dropped, and whose memory is there now.
_HELD: dict[str, Callable[[], object]] = {}
_USER = [""]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it names none, a session on one
    machine (as in tests) gets a folder of its own, and a cluster an error: a local folder is not seen by all."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        shared = tempfile.mkdtemp(dir="/tmp/checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def remember(name: str, drop: Callable[[], object]) -> None:
    """Name a memory that a module keeps in worker processes, and how to drop it."""
    _HELD[name] = drop


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its memory stays


def alone(name: str) -> None:
    """Workers outlive stages: when another operator starts in one, what the last one remembers there goes."""
    if _USER[0] != name:
        for other, drop in _HELD.items():
            if other != name:
                drop()
        trim()
        _USER[0] = name


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that the texts of a block hold about BLOCK_BYTES, or one text; only those become Python strings."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > BLOCK_BYTES:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start), texts.slice(start).to_pylist()
    trim()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later steps
    neither recompute it nor depend on an executor's disk."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_rows(spark: SparkSession) -> None:
    """Keep batches of whole texts small: Arrow's, and those of the Parquet reader, whose one array of a batch's texts
    would otherwise take tens of MB in one piece, for which executors' heaps grow."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(name)) > ARROW_ROWS:
            spark.conf.set(name, str(ARROW_ROWS))


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with a number: a column name that is not taken (names differ in more than case)."""
    low = {c.lower() for c in taken}
    return next(c for c in (name, *(f"{name}{i}" for i in range(len(low) + 1))) if c.lower() not in low)


def gapless_rank(df: DataFrame, key: str, salt: F.Column, order: list, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps among the rows of each ``key`` (not null).

    No task sorts a whole key. Equal rows are counted first, so that copies are one row until the end; rows are dealt by (key, salt), numbered inside
    their sub-bucket and moved up by the sizes of the sub-buckets before it; then copies are made again, COPIES at a time, in tasks of their own. ``salt`` is
    an int from 0 to SALTS-1 that spreads equal keys; ties in ``order`` are rows that
    differ in nothing the caller returns.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).withColumn("_salt", salt)
    w = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, "_salt").agg(F.sum("_c").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .drop("_n")
    )
    before = F.sum("_c").over(Window.partitionBy(key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    ranked = rows.join(starts, [key, "_salt"]).withColumn("_first", F.col("_start") + before)
    parts = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1, F.lit(COPIES).cast("long"))))
    dealt = parts.repartition(key, "_first", "_part")
    each = F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + COPIES, F.col("_c")) - 1))
    return dealt.withColumn("_i", each).withColumn(out, (F.col("_first") + F.col("_i")).cast("long")).select(*df.columns, out)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the undirected ``edges`` (a, b): the smallest id reachable.

    Each pass lets every node point to its least neighbour, follows pointers to their roots
    (in a logarithm of steps, long chains included) and contracts the edges; the loop ends
    when no edge joins two components. Only minima per node are aggregated, so hubs cost one row a task.
    Empty edges give an empty table; self loops and repeats don't matter.
    """
    live = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = live.select(F.col("a").alias("id")).union(live.select(F.col("b").alias("id"))).distinct()
    labels = nodes.withColumn("component", F.col("id"))
    live = live.where("a <> b")
    while not live.isEmpty():
        ends = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p"))
        up = settle(up)
        while True:  # follow pointers to their roots, doubling the step each time
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = settle(up.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.coalesce(F.col("q") != F.col("p"), F.lit(False)).alias("moved")))
            over_all = up.where("moved").isEmpty()
            up = up.drop("moved")
            if over_all:
                break
        labels = settle(
            labels.join(up.withColumnRenamed("v", "component"), "component", "left")
            .select("id", F.coalesce("p", "component").alias("component"))
        )
        left = up.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        live = settle(
            live.join(left, "a").join(right, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    return labels
