"""Exact top-k search by inner product over a vector-approximation file.

Components become integers, held as doubles, which are exact for them.  Equal vectors become one entry
with its smallest ids.  The approximation file is a table of its own in the shared folder: for each entry
one byte for each dimension, the number of its cell on a grid common to all entries, and the distance
from the vector to the centre of its cells.  By Cauchy and Schwarz that distance times the length of a
query bounds how far the score of the centre is from the exact score.

Scan: cells only.  Every task multiplies centres with all queries of a block, keeps for each query the
best lower bounds met so far and yields the entries whose upper bound reaches them; a query's entries
from all tasks are filtered by the lower bound that is certain by then.  Read: exact vectors in the order
of their upper bounds, first as many as are wanted, then those whose bound still reaches the least score
found.  Scores are exact at any size: products that doubles cannot hold are computed with whole numbers.

Defined results.  Vectors that are null, or hold null or non-finite components or such whose multiple by
the scale is not finite, and rows with a null id take no part.  Only vectors as long as the query are
candidates.  A query id on several rows means its least vector.  Repeated rows are candidates one by one;
ties go to the smaller id.  Scores beyond 64 bits are ranked exactly and reported as the nearest long.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import broadcast_if_small, join_groups, ready_workers, release, write_table

#: Bytes of the queries of one pass over the cells; every task holds them.
QUERY_BYTES = 8 << 20
#: Cells along each dimension; a cell number is one byte.
CELLS = 256
#: The share of components beyond either end of the grid, which fall into its end cells.
BEYOND = 0.001
#: Scores that a task computes at once, and the entries that it holds before it yields them.
SCORES_AT_ONCE, HELD = 1 << 21, 1 << 19
#: Doubles hold whole numbers below this exactly.
EXACT = 2.0**53
LEAST, GREATEST = -(2**63), 2**63 - 1


def usable(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): whole components floor(scale * x), as doubles."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))

    def whole(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """(num, v, ids): distinct vectors with their k + 1 smallest ids, each with its number of rows up to k.

    A vector that a third of all rows hold is limited before it is shuffled.
    """
    each = vectors.withColumn("key", F.xxhash64("v")).groupBy("key", "v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    place = F.row_number().over(Window.partitionBy("key", "v").orderBy("vec_id"))
    some = each.withColumn("place", place).filter(F.col("place") <= k + 1)
    one = some.groupBy("key", "v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))
    return one.select(F.monotonically_increasing_id().alias("num"), "v", "ids")


def _grid(entries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the first cell's centre and the width of cells in each dimension."""
    each = entries.select(F.size("v").alias("d"), F.posexplode("v").alias("pos", "x"))
    ends = each.groupBy("d", "pos").agg(F.percentile_approx("x", F.array(F.lit(BEYOND), F.lit(1 - BEYOND)), 1000).alias("ends")).orderBy("d", "pos").collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in ends}:
        low, high = np.array([r["ends"] for r in ends if r["d"] == d]).T
        out[d] = low, np.maximum((high - low) / (CELLS - 1), 1e-9)
    return out


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _cells(entries: DataFrame, grid) -> DataFrame:
    """The approximation file: (num, d, cells, radius)."""
    sent = entries.sparkSession.sparkContext.broadcast(grid)

    def run(batches):
        for batch in batches:
            d = batch.column(1).to_numpy()
            cells, radius = np.empty(len(d), object), np.zeros(len(d))
            for size in np.unique(d):
                at = np.nonzero(d == size)[0]
                if size == 0:
                    cells[at] = b""
                    continue
                v = _matrix(batch.column(2).take(pa.array(at)), size)
                low, width = sent.value[size]
                number = np.rint(np.clip((v - low) / width, 0, CELLS - 1))
                with np.errstate(over="ignore"):
                    radius[at] = np.sqrt(((v - low - number * width) ** 2).sum(1)) * (1 + 1e-9)
                cells[at] = [x.tobytes() for x in number.astype(np.uint8)]
            yield pa.RecordBatch.from_pydict({"num": batch.column(0), "d": batch.column(1), "cells": pa.array(cells.tolist(), pa.binary()), "radius": radius})

    return write_table(entries.select("num", F.size("v").alias("d"), "v").mapInArrow(run, "num long, d int, cells binary, radius double"), "cells")


class Scan:
    """The entries that may be among the `depth` best of some query, from cells seen one block after the other."""

    def __init__(self, numbers: np.ndarray, queries: np.ndarray, grid, depth: int):
        self.numbers, self.q, self.depth = numbers, queries, depth
        self.low, self.width = grid
        with np.errstate(over="ignore"):
            self.length = np.sqrt((queries**2).sum(1))
        self.best = np.full((len(queries), depth), -np.inf)
        self.found: list[tuple] = []
        self.size = 0

    def add(self, num: np.ndarray, cells: np.ndarray, radius: np.ndarray):
        centres = self.low + cells * self.width
        with np.errstate(over="ignore", invalid="ignore"):
            middle = self.q @ centres.T
            slack = 1e-12 * np.sqrt((centres**2).sum(1)) * len(self.low)
            reach = np.nan_to_num(self.length[:, None] * (radius + slack) + 1e-6, nan=np.inf, posinf=np.inf)
            lower, upper = (np.nan_to_num(x, nan=s * np.inf, posinf=np.inf, neginf=-np.inf) for x, s in ((middle - reach, -1), (middle + reach, 1)))
        held = np.concatenate([self.best, lower], axis=1)
        self.best = -np.partition(-held, self.depth - 1, axis=1)[:, : self.depth]
        at = np.nonzero(upper >= self.best.min(1)[:, None])
        self.found.append((at[0], num[at[1]], lower[at], upper[at]))
        self.size += len(at[0])
        if self.size > HELD:
            kept = self._pruned()
            self.found, self.size = [kept], len(kept[0])
            if self.size > HELD // 2:
                self.found, self.size = [], 0
                return self._batch(kept)
        return None

    def _pruned(self) -> tuple:
        q, num, lower, upper = (np.concatenate([f[k] for f in self.found]) for k in range(4))
        ok = upper >= self.best.min(1)[q]
        return q[ok], num[ok], lower[ok], upper[ok]

    def _batch(self, rows: tuple):
        return pa.RecordBatch.from_pydict({"q": pa.array(self.numbers[rows[0]]), "num": pa.array(rows[1]), "lower": rows[2], "upper": rows[3]})

    def rest(self):
        return self._batch(self._pruned()) if self.found else None


def _scan(cells: DataFrame, sent, depth: int) -> DataFrame:
    """(q, num, lower, upper) of the entries that tasks cannot rule out."""

    def run(batches):
        queries, grid = sent.value
        scans = {d: Scan(numbers, matrix, grid[d], depth) for d, (numbers, matrix) in queries.items() if d in grid}
        waiting: dict[int, list] = {d: [] for d in scans}

        def work(d, some):
            num, raw, radius = (np.concatenate([w[k] for w in some]) for k in range(3))
            step = max(1, SCORES_AT_ONCE // len(scans[d].numbers))
            for k in range(0, len(num), step):
                out = scans[d].add(num[k : k + step], raw[k : k + step].astype(np.float64), radius[k : k + step])
                if out is not None:
                    yield out

        for batch in batches:
            length = batch.column(1).to_numpy()
            for d in np.unique(length):
                if d in scans and d:
                    part = batch.filter(pa.array(length == d))
                    raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, d)
                    waiting[d].append((part.column(0).to_numpy(), raw, part.column(3).to_numpy()))
                    if sum(len(w[0]) for w in waiting[d]) >= SCORES_AT_ONCE // 1024:
                        yield from work(d, waiting[d])
                        waiting[d] = []
        for d, some in waiting.items():
            if some:
                yield from work(d, some)
            out = scans[d].rest()
            if out is not None:
                yield out

    return cells.mapInArrow(run, "q long, num long, lower double, upper double")


def order_key(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size that products of doubles reach."""
    if LEAST <= score <= GREATEST:
        return b"\x01" + (score - LEAST).to_bytes(8, "big")
    return (b"\x00" if score < 0 else b"\x02") + (score + (1 << 2300)).to_bytes(320, "big")


def _exact(pairs: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, num, score, key, below) of pairs (q, num): exact vectors are read here and nowhere else; below is a double not above the score."""
    both = pairs.join(entries.select("num", "v"), "num").join(broadcast_if_small(asked), "q").select("q", "num", "v", "w")

    def run(batches):
        for batch in batches:
            d = np.diff(batch.column(2).offsets.to_numpy())
            scores, keys, below = np.zeros(len(d), np.int64), np.empty(len(d), object), np.zeros(len(d))
            for size in np.unique(d):
                at = np.nonzero(d == size)[0]
                v, w = (_matrix(batch.column(k).take(pa.array(at)), size) for k in (2, 3))
                with np.errstate(over="ignore"):
                    small = (np.abs(v) * np.abs(w)).sum(1) < EXACT
                below[at[small]] = (v[small] * w[small]).sum(1)
                scores[at[small]] = below[at[small]].astype(np.int64)
                for i in np.nonzero(~small)[0]:
                    score = sum(int(a) * int(b) for a, b in zip(v[i], w[i]))
                    scores[at[i]], keys[at[i]] = min(max(score, LEAST), GREATEST), order_key(score)
                    near = float(max(min(score, 10**308), -(10**308)))
                    below[at[i]] = near - abs(near) * 1e-12 if score >= -(10**308) else -np.inf
            keys = [order_key(int(s)) if x is None else x for s, x in zip(scores, keys)]
            yield pa.RecordBatch.from_pydict({"q": batch.column(0), "num": batch.column(1), "score": pa.array(scores), "key": pa.array(keys, pa.binary()), "below": pa.array(below)})

    return write_table(both.mapInArrow(run, "q long, num long, score long, key binary, below double"), "scores")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score; queries and rows have the same two columns."""
    spark = rows.sparkSession
    ready_workers(spark)
    entries = write_table(_entries(usable(rows, id_col, vector_col, scale), k), "entries")
    wanted = usable(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("key"), F.col("v").alias("w"))
    wanted = write_table(wanted, "queries")
    distinct = wanted.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.monotonically_increasing_id())
    distinct = write_table(distinct, "asked")
    asked = distinct.select("q", "w")
    members = write_table(join_groups(wanted, distinct, ["key", "w"], "n", wanted.count()).select("q", "query_id"), "members")
    owns = entries.select(F.explode("ids.vec_id").alias("query_id")).join(broadcast_if_small(write_table(wanted.select("query_id"), "own")), "query_id", "left_semi")
    depth = k + (owns.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)  # a query's own vectors may come first

    cells, grid = None, _grid(entries)
    cells = _cells(entries, grid)
    total = asked.agg(F.sum(8 * F.size("w") + 8)).first()[0] or 0
    blocks = max(1, -(-total * 5 // (4 * QUERY_BYTES)))
    parts = []
    for number in range(blocks):
        of_length: dict[int, list] = {}
        for r in (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number)).toLocalIterator():
            of_length.setdefault(len(r["w"]), []).append((r["q"], r["w"]))
        sent = spark.sparkContext.broadcast(({d: (np.array([q for q, _ in some], np.int64), np.array([w for _, w in some], np.float64).reshape(len(some), d)) for d, some in of_length.items()}, grid))
        parts.append(write_table(_scan(cells, sent, depth), "reach"))
    reach = parts[0]
    for part in parts[1:]:
        reach = reach.unionByName(part)

    by_lower, by_upper = (Window.partitionBy("q").orderBy(F.desc(c), "num") for c in ("lower", "upper"))
    certain = reach.withColumn("place", F.row_number().over(by_lower)).filter(F.col("place") <= depth).groupBy("q").agg(F.when(F.count(F.lit(1)) == depth, F.min("lower")).alias("least"))
    near = reach.join(certain, "q").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    near = write_table(near.select("q", "num", "upper", F.row_number().over(by_upper).alias("place")), "near")
    release(cells, *parts)
    first = _exact(near.filter(F.col("place") <= depth), entries, asked)
    least = first.groupBy("q").agg(F.min("below").alias("below"))
    rest = near.filter(F.col("place") > depth).join(least, "q").filter(F.col("upper") >= F.col("below"))
    scored = first.unionByName(_exact(rest, entries, asked))

    ids = scored.join(entries.select("num", "ids"), "num").select("q", "score", "key", F.explode("ids").alias("id")).select("q", "score", "key", "id.vec_id", "id.copies")
    others = ids.join(members, "q").filter("vec_id <> query_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
