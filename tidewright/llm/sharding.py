"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, gapless_rank

#: Jumps that every key is given at once. Few keys need more (ln of the shard count on average); those go on jumping.
JUMPS = 64


def bits(text: Column, digits: int) -> Column:
    """The first hex digits of md5(text) as a long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards-1, of ``key`` (any type; null is a key of its own).

    A key's jumps are a fixed rising sequence: from b it goes to floor((b + 1) / r), r
    uniform in (0, 1] from the key and the step. The shard is the last target below
    ``shards``; appending a shard thus moves a key only if that shard is a target.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def step(at, k):
        r = bits(F.concat(name, F.lit(":"), k.cast("string")), 8).bitwiseAND(0x7FFFFFFF) + 1
        there = F.floor((at["j"] + 1) * F.lit(2147483648) / r)
        return F.when(
            at["j"] < shards, F.struct(at["j"].alias("b"), there.cast("long").alias("j"))
        ).otherwise(at)

    def jumped(first: int, last: int, start: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), start, step)

    at = jumped(0, min(shards, JUMPS), F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")))
    if shards > JUMPS:  # each jump is to a higher shard, so that there are no more jumps than shards
        at = F.get(F.transform(F.array(at), lambda a: F.when(a["j"] >= shards, a).otherwise(jumped(JUMPS + 1, shards, a))), F.lit(0))
    return at["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to shards by their key alone.

    Returns doc_id, size (UTF-8 bytes + 1; 1 if the text is null), text_crc32 (of the UTF-8
    bytes; null text: as empty), law 'key', shard, slot (0, 1, ... in the shard) and
    grown_shard (with one more shard). Null keys share one shard; repeated keys share a
    shard; columns besides key and text are dropped; an empty table gives no rows. One
    shuffle carries 30 bytes a row; no task holds a whole shard, a copied text or a hot key.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    mix = F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    salt = F.floor(bits(mix, 3) * SALTS / 4096).cast("int")
    out = gapless_rank(rows, "shard", salt, [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
