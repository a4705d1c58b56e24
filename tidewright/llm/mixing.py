"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bits of the document's hash that one histogram resolves, and bits in all.
LEVEL_BITS, HASH_BITS = 12, 60
#: No source, and so no document, is taken more often.
MOST = 3
#: Tables of sources are broadcast up to this size, counted first; larger ones are dealt by source and so many salts.
BROADCAST_BYTES, SPREAD = 8 << 20, 16


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab and the line breaks up to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights: tuple[int, ...], most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. A target is
    min(most * size, weight * level) with the level at which targets add up to all sizes:
    the fixed point of resharing every excess by weight. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int") + 1).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / F.sum("w").over(after)
        ).alias("level"),
        (F.lit(float(most)) * F.col("source_size") / F.col("w")).alias("full"),
    )
    level = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    return levels.select(
        "source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.col("w") * level).alias("target")
    )


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, whole, cut): every document is taken ``whole`` times, and once more if its hash is below ``cut``.

    ``sized`` has source, size, h. A histogram of sizes over the leading bits of the hash
    finds, per source, the bin in which the rest of its target ends; only documents of that
    bin go into the next histogram, of the next bits, until bins are single hashes. Bigger
    targets give higher cuts, so mixes are nested. The hash at the boundary is taken if that
    comes nearer to the target.
    """
    edge = plan.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
        F.col("target").alias("rest"),
        F.col("source_size").alias("n"),
    ).select("source", "whole", (F.col("rest") - F.col("whole") * F.col("n")).alias("rest"), F.lit(0).cast("long").alias("cut"))
    edge = settle(edge)
    inside = sized.where("size > 0").select("source", "size", "h")
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        step = 1 << low
        bins = inside.groupBy("source", F.expr(f"h div {step}L").alias("bin")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")
        )
        run = Window.partitionBy("source").orderBy("bin")
        reach = bins.withColumn("upto", F.sum("size").over(run))
        reach = reach.withColumnRenamed("source", "s")
        ends = (
            reach.join(edge, F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("s")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("below"), "size", "docs")).alias("m"))
            .select("s", "m.*")
        )
        last = low == 0
        nearer = F.col("rest") - F.col("below") >= F.col("size") / 2
        moved = edge.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "whole",
            F.coalesce(F.col("rest") - F.col("below"), F.lit(0.0)).alias("rest"),
            F.when(F.col("bin").isNull(), F.greatest(F.col("cut"), F.lit(1 << HASH_BITS if low == HASH_BITS - LEVEL_BITS else 0)))
            .otherwise((F.col("bin") + F.when(nearer & (F.lit(last) | (F.col("docs") == 1)), 1).otherwise(0)) * step).alias("cut"),
            F.coalesce((F.col("docs") > 1) & F.lit(not last), F.lit(False)).alias("open"),
            "bin",
        )
        moved = settle(moved)
        edge = moved.select("source", "whole", "rest", "cut")
        opened = moved.where("open").select(F.col("source").alias("s"), F.col("bin").alias("b"))
        if last or opened.isEmpty():
            break
        inside = inside.join(
            opened, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"h div {step}L") == F.col("b")), "left_semi"
        )
    return edge.select("source", "whole", "cut")


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with source and doc_id) joined to table (_mix_source, ...; one row a source), nulls matched.

    A table that has been found to be small goes to the rows. Otherwise rows are dealt by
    source and a salt from their id, the table to every salt, so that a hot source is split.
    """
    bytes_of = F.coalesce(F.octet_length("_mix_source"), F.lit(0)) + 64
    if (table.agg(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_mix_source")))
    salted = table.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    same = F.col("source").eqNullSafe(F.col("_mix_source")) & (F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)) == F.col("_mix_salt"))
    return rows.join(salted, same).drop("_mix_salt")


def hash_of() -> F.Column:
    """60 bits of md5 of the id; without an id of the text, so that such rows of a source are taken one by one; without either of 'null'."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("null"))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h (see hash_of) of every document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_of().alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    Every source, null included, gets its target (see budgets) to within half a boundary
    document: whole passes over the source, then the documents whose hash is below its cut.
    Documents that repeat an id are taken alike, as are those without one that repeat a text; wordless ones count 0 and are taken with the
    whole passes; an empty table gives no rows. Text is read once; the rest works on 40 bytes
    a document. Histograms are summed before the shuffle, so a hot source costs no more.
    """
    rows = settle(sized(docs))
    plan = settle(budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    cuts = thresholds(rows, plan).withColumnRenamed("source", "_mix_source")
    by = settle(plan.join(cuts, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("source"))
    copies = F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return (
        by_source(rows, by)
        .withColumn("copies", copies.cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "h", "cut", "whole")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The mix itself: the rows of docs, as they are, each as often as the mix takes it."""
    rows = settle(sized(docs))
    plan = settle(budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    cuts = thresholds(rows, plan).select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("cut").alias("_mix_cut"))
    copies = (F.col("_mix_whole") + F.when(hash_of() < F.col("_mix_cut"), 1).otherwise(0)).cast("int")
    return (
        by_source(docs, cuts)
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies)))
        .select(*docs.columns)
    )
