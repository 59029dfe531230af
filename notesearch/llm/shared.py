"""What several corpus operators need: shared storage, skew-safe joins, running totals."""

from __future__ import annotations

import ctypes
import gc
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window

from ..session import release, stable as write_table  # noqa: F401

#: Bytes that separate words: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A group larger than 1 / HEAVY_SHARE of all rows is heavy, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 20_000
#: Groups up to this size are never heavy.
LIGHT_ROWS = 100
#: A table is broadcast if its rows, as measured, hold at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes of text in one Arrow batch, and its most rows.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 256


def ready_workers(spark: SparkSession) -> None:
    """Bounds the bytes and rows of Arrow batches of this session, so that long texts fit in a Python worker, and lets workers import this package.

    Workers on other machines need the package installed or sent with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here, known = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (known.get("PYTHONPATH"), here) if x)


def give_back() -> None:
    """Returns a worker's free memory to the machine; called when a task ends, as workers live on beside other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def own_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that no taken name equals, whatever its case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        k = 0
        while f"__{name}{k}" in used:
            k += 1
        out.append(f"__{name}{k}")
        used.add(out[-1])
    return out


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_safe_key(column: Column) -> Column:
    """A string that tells null from every value, so that plain equality joins null with null."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text))


def text_digest(text: Column) -> Column:
    """32 bytes that tell texts apart; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def measured(table: DataFrame) -> tuple[int, int]:
    """Rows of a written table and the bytes they hold, variable parts included."""
    size = F.lit(16)
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            size = size + 24 + 8 * F.greatest(F.size(column), F.lit(0))
        else:
            size = size + 8
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its measured bytes allow; beyond that a shuffle joins it."""
    return F.broadcast(table) if measured(table)[1] <= BROADCAST_BYTES else table


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Joins rows with one row per group without sending a hot group to one task.

    Groups of at most BROADCAST_BYTES, as measured, are broadcast.  Beyond that, groups carries the group's number of rows in column ``size``.  A group of more than
    max(LIGHT_ROWS, n_rows / HEAVY_SHARE) rows is heavy: at most HEAVY_SHARE groups can be, so they
    are broadcast; keys and other columns are of fixed width.  The others are joined by a shuffle in which no key has more rows than that.
    groups is read more than once: pass a written table.
    """
    if measured(groups)[1] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), keys, how)
    bound = max(LIGHT_ROWS, n_rows // HEAVY_SHARE)
    extra = [c for c in groups.columns if c not in keys]
    heavy = groups.filter(F.col(size) > bound)
    light = groups.filter(F.col(size) <= bound)
    tagged = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    done = tagged.filter(F.col("__heavy").isNotNull()).drop("__heavy")
    rest = tagged.filter(F.col("__heavy").isNull()).drop("__heavy", *extra)
    return done.unionByName(rest.join(light, keys, how).select(done.columns))


def bucket_bits(n_rows: int, least: int = 8, rows_per_bucket: int = 50_000) -> int:
    """Bits of hash that deal a group of any size into buckets of about rows_per_bucket."""
    return max(least, (max(1, n_rows) // rows_per_bucket).bit_length())


def order_hash(*columns: Column) -> Column:
    """60 bits of MD5 over the columns joined by newlines, null as a minus sign: an order that other engines can compute."""
    text = F.concat_ws("\n", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def with_bucket(rows: DataFrame, hash_column: str, bits: int, width: int = 64) -> DataFrame:
    """Adds ``__bucket``: the first bits of a hash of so many bits."""
    return rows.withColumn("__bucket", F.shiftrightunsigned(F.col(hash_column), width - bits))


def bucket_totals(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """One row per (group, bucket): its sum and the sum of the group's buckets before it.

    The window runs over buckets, not rows, so a hot group costs no more than a cold one.
    """
    totals = rows.groupBy(group, "__bucket").agg(F.sum(value).alias("__bucket_sum"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("__bucket_sum").over(before), F.lit(0)))


def within_bucket(rows: DataFrame, group: str, value: Column, order: list) -> DataFrame:
    """Adds ``__inside``: the sum of value over the rows before this one in its bucket."""
    w = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
