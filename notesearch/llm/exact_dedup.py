"""Exact deduplication by two passes over a Bloom filter.

Every text hashes to one block of the filter and to two slots in it.  Pass one marks the slots that
more than one row hits.  Pass two tests each row: a row of which some slot was hit once only is unique
and passes straight through; only the others are shuffled and grouped by their digest.

The filter has SLOTS_A_ROW slots for each row and as many blocks as that takes, so that it lets through
the same small share of unique rows (under 2 %) at every size.  Pass one packs the hashes of a task into
one list for each block before anything is shuffled: (task, block) lists first, then blocks, whose lists
hold a hash once for each task, so that copies of one text weigh no more than the number of tasks.  In
pass two the blocks are broadcast while they hold at most BROADCAST_BYTES; beyond that, digests and ids
meet their block by number and texts are compared with the dropped rows only.

Defined results.  Null text counts as empty.  The smallest doc_id of a group stays; null ids come
last, and a group with null ids only keeps them.  In the report, rows that share doc_id and text share
its verdict; drop_copies leaves one row of each group, the least by the hash of its columns.  An empty
table gives an empty result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import GAP, join_groups, measured, own_names, write_table

#: Slots of a block (fixed by Spark's bitmap functions) and slots of the filter for each row.
BLOCK_SLOTS = 1 << 15
SLOTS_A_ROW = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def digest_of(text: Column) -> Column:
    """Texts are equal where these 32 bytes are."""
    return F.unhex(F.sha2(normalised(text), 256))


def n_blocks(n_rows: int) -> int:
    return max(1, -(-n_rows * SLOTS_A_ROW // BLOCK_SLOTS))


def block_of(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(blocks))


def slots_of(digest: Column) -> Column:
    """The two slots of a digest within its block, as one number of 30 bits."""
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(1)), 34).cast("int")


def _first(slots: Column) -> Column:
    return F.shiftright(slots, 15)


def _second(slots: Column) -> Column:
    return slots.bitwiseAND(F.lit(BLOCK_SLOTS - 1))


def repeated_slots(prints: DataFrame, blocks: int) -> DataFrame:
    """The filter: one row (block, block_rows, bits) for each block that a row hits; set bits are slots that several rows hit.

    prints is a written table with the column digest.
    """
    hits = prints.select(F.spark_partition_id().alias("task"), block_of(F.col("digest"), blocks).alias("block"), slots_of(F.col("digest")).alias("slots"))
    of_task = hits.groupBy("task", "block").agg(F.sort_array(F.collect_list("slots")).alias("all"))
    again = F.array_distinct(F.filter("all", lambda v, k: (k > 0) & (v == F.get(F.col("all"), k - 1))))
    packed = of_task.select("block", F.concat(F.array_distinct("all"), again).alias("all")).repartition("block")
    each = packed.select("block", F.explode("all").alias("slots"))
    counted = each.select("block", F.explode(F.array(_first(F.col("slots")), _second(F.col("slots")))).alias("slot")).groupBy("block", "slot").agg(F.count(F.lit(1)).alias("hits"))
    slot = F.when(F.col("hits") > 1, F.col("slot").cast("long"))
    return counted.groupBy("block").agg((F.sum("hits") / 2).cast("long").alias("block_rows"), F.bitmap_construct_agg(slot).alias("bits"))


def _is_set(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*(byte.bitwiseAND(F.lit(1 << k)) for k in range(8))), slot.bitwiseAND(F.lit(7))) > 0


def flag_repeats(rows: DataFrame, bloom: DataFrame, blocks: int, n_rows: int, digest: str = "digest") -> tuple[DataFrame, str]:
    """rows with one more column, and its name: false only for rows whose digest occurs once.  bloom is a written table."""
    block, in_block, bits, slots, maybe = own_names(rows.columns, "block", "rows", "bits", "slots", "maybe")
    asked = rows.withColumns({block: block_of(F.col(digest), blocks), slots: slots_of(F.col(digest))})
    named = bloom.select(F.col("block").alias(block), F.col("block_rows").alias(in_block), F.col("bits").alias(bits))
    met = join_groups(asked, named, [block], in_block, n_rows, "left")
    found = _is_set(F.col(bits), _first(F.col(slots))) & _is_set(F.col(bits), _second(F.col(slots)))
    return met.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(maybe)), maybe


def _filtered(prints: DataFrame):
    n = prints.count()
    blocks = n_blocks(n)
    return n, blocks, write_table(repeated_slots(prints, blocks), "bloom")


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return write_table(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "prints")


def _groups(candidates: DataFrame) -> DataFrame:
    grouped = candidates.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return write_table(grouped.filter(F.col("group_size") > 1), "copies")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text)."""
    prints = _prints(docs, id_col, text_col)
    n, blocks, bloom = _filtered(prints)
    flagged, maybe = flag_repeats(prints, bloom, blocks, n)
    candidates = flagged.filter(maybe).select("doc_id", "digest")
    judged = join_groups(candidates, _groups(candidates), ["digest"], "group_size", n, "left").select("doc_id", "digest", "keep_id", "group_size")
    alone = flagged.filter(~F.col(maybe)).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    size = F.coalesce(F.col("group_size"), F.lit(1)).cast("long")
    return judged.unionByName(alone).select(
        "doc_id",
        F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        size.alias("group_size"),
        ((size == 1) | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, columns unchanged.

    Rows that the filter lets through unflagged are not shuffled.  Of the flagged ones those with another id than the group's
    least go by an anti-join; where several rows have the least id, one is left by a partial aggregation.
    """
    columns = docs.columns
    prints = _prints(docs, id_col, text_col)
    n, blocks, bloom = _filtered(prints)
    flagged, maybe = flag_repeats(prints, bloom, blocks, n)
    candidates = flagged.filter(maybe).select("doc_id", "digest")
    judged = join_groups(candidates, _groups(candidates), ["digest"], "group_size", n, "inner")
    is_least = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    digest, dropped_id, dropped, again, first, order = own_names(columns, "digest", "id", "dropped", "again", "first", "order")
    others = write_table(judged.filter(~is_least).select(F.col("doc_id").alias(dropped_id), F.col("digest").alias(dropped)).distinct(), "dropped")
    several = write_table(judged.filter(is_least).groupBy("digest").count().filter("count > 1").select(F.col("digest").alias(digest), F.lit(True).alias(again)), "repeated")
    wide = docs.withColumn(digest, digest_of(F.col(text_col)))
    if measured(bloom)[1] <= shared.BROADCAST_BYTES:
        wide, maybe = flag_repeats(wide, bloom, blocks, n, digest)
    else:  # a filter that does not go to the texts; they meet the dropped rows, by broadcast if those are few
        (maybe,) = own_names(wide.columns, "maybe")
        wide = wide.withColumn(maybe, F.lit(True))
    same = (F.col(digest) == F.col(dropped)) & F.col(id_col).eqNullSafe(F.col(dropped_id))
    none_again = measured(several)[0] == 0
    if none_again and measured(others)[1] <= shared.BROADCAST_BYTES:  # no row moves, so one pass over the texts serves flagged and unflagged rows
        return wide.join(F.broadcast(others), F.col(maybe) & same, "left_anti").select(columns)
    left = wide.filter(maybe).drop(maybe).join(shared.broadcast_if_small(others), same, "left_anti")
    if none_again:
        return left.select(columns).unionByName(wide.filter(~F.col(maybe)).select(columns))
    left = left.join(shared.broadcast_if_small(several), digest, "left")
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = left.filter(F.col(again).isNotNull()).groupBy(digest).agg(F.min_by(row, F.xxhash64(*hashable)).alias(first)).select(f"{first}.*")
    return left.filter(F.col(again).isNull()).select(columns).unionByName(one).unionByName(wide.filter(~F.col(maybe)).select(columns))
