"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a gram and grams in a window: a run of K + W - 1 = 11 equal words is always seen.
#: Both are powers of two.
K, W = 4, 8
#: The rolling hash counts modulo a prime below 2**31, so products stay in a long.
PRIME, BASE = 2147483647, 1000003
#: A word is a run of letters, marks and digits, or any other visible character.
WORD = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
#: Hashes of texts that order the rows of one id, and the least id.
TIES, LEAST_ID = 1 << 16, -(1 << 63)
#: Room for a position beside a hash in one long.
PLACES = 1 << 32


def _beside(x: str, by: int, join) -> Column:
    """join(item, the item ``by`` places on) over the array x."""
    n = F.greatest(F.size(x) - by, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(by + 1), n), join)


def _rolled(power: int):
    return lambda a, b: (a * power + b) % PRIME


def _mark(h: Column, i: Column) -> Column:
    return h * F.lit(PLACES) + (F.lit(PLACES - 1) - i)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the winnowed text: an array of hash * 2**32 + (2**32 - 1 - position).

    The hash of every K words is sum of word * BASE**(K-1-i) modulo PRIME, as rolling one
    word in and one out gives; here it is built by doubling, two half grams side by side,
    which needs no running state. Of every W grams in a row the least hash is kept, of equal
    ones the rightmost, once, with its position in grams; they stay in order of position.
    A text of fewer words than K is one gram, fewer grams than W are one window, and a text
    without words (null, empty, white space) has an empty fingerprint. Each step is a column
    of its own, so that no array is worked out twice.
    """
    none = F.array().cast("array<bigint>")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    df = df.withColumn("_words", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    at, span = "_words", 1
    while span < K:
        power = pow(BASE, span, PRIME)
        df = df.withColumn(f"_g{2 * span}", _beside(at, span, _rolled(power)))
        at, span = f"_g{2 * span}", 2 * span
    short = F.aggregate("_words", F.lit(0).cast("long"), lambda a, b: (a * BASE + b) % PRIME)
    df = df.withColumn(
        "_m1",
        F.when(F.size("_words") >= K, F.transform(at, _mark))
        .when(F.size("_words") > 0, F.array(_mark(short, F.lit(0))))
        .otherwise(none),
    )
    at, span = "_m1", 1
    while span < W:
        df = df.withColumn(f"_m{2 * span}", _beside(at, span, lambda a, b: F.least(a, b)))
        at, span = f"_m{2 * span}", 2 * span
    kept = F.when(F.size("_m1") >= W, F.array_distinct(at)).when(F.size("_m1") > 0, F.array(F.array_min("_m1"))).otherwise(none)
    df = df.withColumn(out, kept)
    return df.drop("_words", *(f"_g{2 << i}" for i in range(K.bit_length() - 1)), *(f"_m{1 << i}" for i in range(W.bit_length())))


def spelled(fingerprint: str) -> Column:
    """hash:position, comma-joined, in order of position; hashes in hexadecimal."""
    one = lambda v: F.concat(F.hex(F.shiftright(v, 32)), F.lit(":"), (F.lit(PLACES - 1) - v.bitwiseAND(PLACES - 1)).cast("string"))
    return F.array_join(F.transform(fingerprint, one), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the hashes of two fingerprints, wherever they stand; 1 if both are empty."""
    hashes = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(hashes(a), hashes(b))) / either)


def below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below a value: of blocks of them, then within one, so that a row is held against some 2 * sqrt(n) of n bounds."""
    size = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    if not blocks:
        return F.lit(0)
    lower = lambda x: F.size(F.filter(x, lambda b: b < value))
    first = lower(F.array(*(F.lit(b[-1]) for b in blocks)))
    within = F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), first)
    return F.least(first * size + F.coalesce(F.nullif(lower(within), F.lit(-1)), F.lit(0)), F.lit(len(bounds)))


def in_ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, _b, _g, _s) of all rows, and the greatest id of each range that has ids.

    Rows stand by descending doc_id (null ids last), those of one id by _b, a hash of the text, then by text. Ids are
    cut into ranges _g by ``parts`` quantiles; an id that fills several of them, and the rows
    without an id (_g = -1), are cut further (_s) along _b, into as many pieces as their share of the
    rows asks for. So a piece holds about a part of the rows whatever ids repeat, and there are 3 * parts pieces at most.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts) if parts > 1 else F.array().cast("array<bigint>")
    seen = docs.agg(cuts.alias("b"), F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    share = Counter(seen["b"] or [])
    bounds = sorted({*share, *(b - 1 for b, n in share.items() if n > 1 and b > LEAST_ID)})
    group = below(F.col("doc_id"), bounds)
    group = F.when(F.col("doc_id").isNull(), -1).otherwise(group)
    pieces = {bounds.index(b): n + 1 for b, n in share.items() if n > 1}
    pieces[-1] = 1 + parts * (seen["n"] - seen["ids"]) // max(seen["n"], 1)
    many = F.element_at(F.create_map(*(F.lit(x) for pair in pieces.items() for x in pair)), F.col("_g"))
    rows = rows.withColumn("_g", group).withColumn("_b", F.pmod(F.xxhash64("text"), F.lit(TIES)).cast("int"))
    rows = rows.withColumn("_s", F.floor(F.col("_b") * F.coalesce(many, F.lit(1)).cast("long") / TIES).cast("int"))
    tops = docs.where("doc_id is not null").groupBy(group.alias("g")).agg(F.max("doc_id").alias("top")).collect()
    return rows, sorted(r["top"] for r in tops)


def with_next(docs: DataFrame, columns, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) with ``columns(df)`` applied, and next_<c> of each added column and of text.

    Next is the document that follows by descending doc_id (null ids last, equal ids by a hash
    of the text, then by text), after the last the first. Every piece of in_ranges (``parts``: four times
    the shuffle partitions unless given; the driver sees a row a piece) is one window, with the first
    document of the piece after it as its last row. So texts are shuffled once and no task
    holds all of them, nor all rows of an id or without one; only rows that equal in id and text stay together.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, wanted = in_ranges(docs, parts)
    ends = rows.where(F.col("doc_id").isin(wanted) | F.col("doc_id").isNull())
    heads = ends.groupBy("_g", "_s").agg(F.min("_b").alias("b")).collect()
    heads = sorted(((r["_g"], r["_s"], r["b"]) for r in heads), key=lambda r: (-r[0], r[1]))
    after = [(g, s, b, *heads[i - 1][:2]) for i, (g, s, b) in enumerate(heads)]
    firsts = spark.createDataFrame(after, "_g int, _s int, _b int, g int, s int")
    edge = ends.join(F.broadcast(firsts), ["_g", "_s", "_b"]).groupBy("doc_id", "g", "s", "_b").agg(F.min("text").alias("text"))
    edge = edge.select("doc_id", "text", F.col("g").alias("_g"), "_b", F.col("s").alias("_s"), F.lit(1).alias("_last"))
    full = columns(rows.withColumn("_last", F.lit(0)).unionByName(edge))
    order = Window.partitionBy("_g", "_s").orderBy("_last", F.col("doc_id").desc_nulls_last(), "_b", "text")
    added = [c for c in full.columns if c not in ("doc_id", "_g", "_s", "_b", "_last")]
    return full.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in added)).where("_last = 0").drop("_g", "_s", "_b", "_last")


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document. Null text counts as empty; rows that repeat an id are rows
    of their own; a lone document is its own next; an empty table gives no rows.
    """
    rows = with_next(docs, lambda df: with_fingerprint(df, "text", "fp"), parts)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_fingerprint(rows.drop("next_text"), "edited", "efp")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        spelled("fp").alias("fingerprint"),
        spelled("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
