"""Mixing sources to target weights under a time-varying curriculum.

Every source has a share of the words, and a schedule that says how its weight moves while training
goes from 0 to 1.  The integral of the schedule gives the words that the source must have delivered
by any moment.  Each document holds a stretch of its source's stream of words; inverting the
cumulative demand at the start of that stretch gives the moment at which the document is read, its
training position.  Documents are range-sorted by position.

The stream of a source is ordered by a hash of id, source and text, so reruns agree.  Offsets come from
sums over hash buckets and then within a bucket, so a source of any size is split among tasks.

Defined results.  Null text has 0 words and is never taken.  A null source is a source of its own,
ranked last.  Without words all targets are 0.  Rows with equal ids each hold their own stretch.  Rows
equal in id, source and text are counted once with their number of copies and hold one stretch for each
copy; in mixed_documents the least of them by the hash of all columns stands for all.  Other columns,
whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import broadcast_if_small, bucket_bits, bucket_totals, null_safe_key, order_hash, own_names, with_bucket, within_bucket, words_in, write_table

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: By the same rank: weight multipliers at equally spaced moments from 0 to 1, linear between.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Words of the mix against words of all documents, and the most times a source is read.
BUDGET = 1.5
MOST_REPEATS = 2
#: Bits of the hash that orders a source, and the copies of equal rows that one array spans.
HASH_BITS, COPIES_AT_ONCE = 60, 10_000


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """totals (key, source, source_size) with rank, weight and target.

    A target is weight * level, but at most most * size; the level is where the targets sum to the
    budget.  Sources fill up in order of size / weight, so the level follows from running sums: this
    is where sharing out the excess again and again ends.  One row per source.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("cap", most * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    total = budget * F.sum(F.col("source_size").cast("double")).over(everything)
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", F.greatest(total - before, F.lit(0.0)) / left).withColumn("fill", F.col("cap") / F.col("weight"))
    final = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "rank", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap")))).drop("cap", "level", "fill")


def _segments(schedule) -> list[tuple[float, float, float, float, float]]:
    """(start, length, multiplier there, slope, part of the whole delivered before) of each linear stretch."""
    length = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * length for a, b in zip(schedule, schedule[1:])]
    whole, out, done = sum(areas), [], 0.0
    for k, (a, b) in enumerate(zip(schedule, schedule[1:])):
        out.append((k * length, length, a / whole, (b - a) / whole / length, done))
        done += areas[k] / whole
    return out


def moment(part: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The moment at which a source has delivered `part` of its target: the inverse of its cumulative demand.

    On a linear stretch the demand is done + a x + s x**2 / 2, so x = 2 d / (a + sqrt(a**2 + 2 s d)).
    """
    by_rank = None
    for k, schedule in enumerate(schedules):
        inverse = None
        for start, length, a, slope, done in _segments(schedule):
            d = part - done
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * d, F.lit(0.0)))
            x = F.least(2 * d / F.greatest(a + root, F.lit(1e-12)), F.lit(length))
            inverse = start + x if inverse is None else F.when(part >= done, start + x).otherwise(inverse)
        chosen = F.pmod(rank - 1, F.lit(len(schedules))) == k
        by_rank = F.when(chosen, inverse) if by_rank is None else by_rank.when(chosen, inverse)
    return by_rank


def _stretches(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, budget: float, most: int) -> DataFrame:
    """One row for rows equal in id, source and text: key, hash, doc_id, size, copies, start of its stretch, and its source's figures."""
    row = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), order_hash(F.col(id_col), F.col(source_col), F.col(text_col)).alias("hash"))
    row = row.withColumn("key", null_safe_key(F.col("source")))
    rows = write_table(row.groupBy("key", "source", "hash", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    rows = with_bucket(rows, "hash", bucket_bits(rows.count()), HASH_BITS)
    words = F.col("size") * F.col("copies")
    buckets = write_table(bucket_totals(rows, "key", words), "buckets")
    named = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("source")
    totals = buckets.groupBy("key").agg(F.sum("__bucket_sum").alias("source_size")).select("key", named, "source_size")
    targets = source_targets(totals, weights, budget, most).drop("source")
    offsets = buckets.join(targets, "key").select("key", "__bucket", "__before", "rank", "source_size", "target")
    placed = within_bucket(rows, "key", words, ["hash", "doc_id", "size"]).join(offsets, ["key", "__bucket"])
    return placed.withColumn("start", F.col("__before") + F.col("__inside")).drop("__bucket", "__before", "__inside")


def _each_copy(rows: DataFrame, copies: Column, start: Column, size: Column, name: str, held: str) -> DataFrame:
    """rows once for each copy, the start of its own stretch as name; held is a free name.  No array is longer than COPIES_AT_ONCE."""
    several = rows.withColumn(held, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / COPIES_AT_ONCE))))
    first = F.col(held) * COPIES_AT_ONCE
    several = several.withColumn(held, F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, copies) - 1)))
    return several.withColumn(name, start + F.col(held) * size).drop(held)


def _reads(start: Column, size: Column, source_size: Column, target: Column, rank: Column, schedules, most: int) -> tuple[Column, Column]:
    """Words taken of a stretch that begins at start, and the moments at which it is read, earliest first."""
    target_words = F.floor(target).cast("long")
    taken, positions = F.lit(0).cast("long"), []
    for k in range(most):
        at = start + k * source_size
        now = F.greatest(F.lit(0).cast("long"), F.least(size, target_words - at))
        taken = taken + now
        positions.append(F.when(now > 0, moment(F.try_divide(at.cast("double"), target), rank, schedules)))
    return taken, F.array_compact(F.array(*positions))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, taken (words, repeats counted), positions (one for each time it is read, earliest first)."""
    stretches = _stretches(docs, id_col, text_col, source_col, weights, budget, most)
    each = _each_copy(stretches, F.col("copies"), F.col("start"), F.col("size"), "at", "copy")
    taken, positions = _reads(*map(F.col, ("at", "size", "source_size", "target", "rank")), schedules, most)
    return each.select("doc_id", "hash", "size", "source", "source_size", "target", taken.alias("taken"), positions.alias("positions"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """plan_mix range-sorted by first position; documents that are never read come last."""
    plan = plan_mix(docs, **options)
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    sorted_plan = plan.withColumn("position", F.try_element_at("positions", F.lit(1))).withColumn("__first", first)
    return sorted_plan.repartitionByRange("__first", "hash").sortWithinPartitions("__first", "hash").drop("__first", "hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """docs as training reads them: one row for each time a document is read, range-sorted by position.

    Columns are unchanged.  Documents that the mix does not take are absent.  Texts move once, in the sort, while
    the plan is small enough to go to them; a larger plan meets them by a shuffle on the hash.
    """
    columns = docs.columns
    wanted = ("hash", "id", "size", "key", "copies", "start", "whole", "target", "rank")
    names = own_names(columns, "my_hash", "my_size", "my_key", "at", "held", "position", "row", *wanted)
    my_hash, my_size, my_key, at, held, position, row = names[:7]
    hash_, id_, size, key, copies, start, whole, target, rank = names[7:]
    stretches = _stretches(docs, id_col, text_col, source_col, weights, budget, most)
    of = ("hash", "doc_id", "size", "key", "copies", "start", "source_size", "target", "rank")
    used = F.floor("target") > F.col("start")
    plan = write_table(stretches.filter(used & (F.col("size") > 0)).select(*(F.col(c).alias(n) for c, n in zip(of, names[7:]))), "stretches")
    text = docs.withColumns({my_hash: order_hash(F.col(id_col), F.col(source_col), F.col(text_col)), my_size: words_in(F.col(text_col)), my_key: null_safe_key(F.col(source_col))})
    same = (F.col(my_hash) == F.col(hash_)) & F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(my_size) == F.col(size)) & (F.col(my_key) == F.col(key))
    met = text.join(broadcast_if_small(plan), same).drop(my_hash, my_size)
    figures = [hash_, size, copies, start, whole, target, rank]
    alone = met.filter(F.col(copies) == 1).select(*columns, *figures).withColumn(at, F.col(start))
    if plan.filter(F.col(copies) > 1).limit(1).count():
        hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.xxhash64(*hashable)).alias(row)
        one = met.filter(F.col(copies) > 1).groupBy(*figures, id_, key).agg(least).select(f"{row}.*", *figures)
        alone = alone.unionByName(_each_copy(one, F.col(copies), F.col(start), F.col(size), at, held))
    _, positions = _reads(*(F.col(c) for c in (at, size, whole, target, rank)), schedules, most)
    each = alone.withColumn(position, F.explode(positions))
    return each.repartitionByRange(position, hash_).sortWithinPartitions(position, hash_).select(columns)
