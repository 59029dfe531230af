"""Sharding by jump consistent hashing.

A key walks through the shard counts at which it would move, drawing each next one from a random
sequence that the key seeds; the last one within the number of shards is its shard.  No table is
kept, the shards are even, and one more shard takes only the rows that move into it.

Law `key`: doc_id and the shard count decide.  Slots number the rows of a shard without gaps.  They
come from counts of hash buckets and ranks within a bucket, so no task holds a whole shard.

Defined results.  Null ids share one shard.  Null text has 0 bytes.  Rows with equal ids share a shard
and have slots of their own.  Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_bits, bucket_totals, order_hash, with_bucket, within_bucket, write_table

#: Bytes that storing a row takes besides its text.
ROW_BYTES = 16


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of key, from 0 to shards - 1.

    At shard b the next one is floor((b + 1) / u) for the key's next uniform u in (0, 1], the first 32 bits of
    MD5 over key and step.  A key moves at most `shards` times, and about ln(shards) times on average.
    """
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def walk(state, k):
        drawn = F.md5(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("-")), k.cast("string")).cast("binary"))
        u = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 32))
        ahead = F.least(F.floor((state["j"] + 1) / u), F.lit(1 << 40)).cast("long")
        moved = F.struct(state["j"].alias("b"), ahead.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    steps = F.sequence(F.lit(0), F.lit(shards - 1))
    return F.aggregate(steps, start, walk)["b"].cast("int")


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (its shard if there were one more)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1), "hash": order_hash(F.col("doc_id"), F.col("text_crc32"))})
    rows = write_table(rows, "shards")
    rows = with_bucket(rows, "hash", bucket_bits(rows.count()), 60)
    buckets = bucket_totals(rows, "shard", F.lit(1)).select("shard", "__bucket", "__before")
    placed = within_bucket(rows, "shard", F.lit(1), ["hash", "doc_id", "size"]).join(buckets, ["shard", "__bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__inside")).cast("long").alias("slot"), "grown_shard")
