"""Near-duplicate detection with b-bit MinHash.

Texts become sets of hashed word shingles.  Band keys of full minima give candidate groups.  A
packed signature keeps the low bits of one-permutation minima; similarity is estimated from bit
counts, corrected for bins that agree by chance, and pairs that could reach the threshold are
confirmed on the full sets.

A group of copies is never expanded into all pairs.  Texts with equal sets are one class.  Within a
band group, a first round confirms one spanning forest of the most similar pairs; a second round
tests every pair whose members are still in different components and whose sketches do not rule the
link out: by bounds that always hold, or by an estimate so low that MISS bounds its probability.

Work in large band groups follows their rows, not their pairs.  In round two the rows outside the
largest component of a group are its minority.  A minority of at most MINORITY rows is copied to every
block of the rest.  A larger one, as when many texts share a passage and little else, is recut: its rows
meet again in bands of further minima, drawn independently, where texts that share only the passage
part and linked texts part with the probability of missing all bands (3 in a million at similarity
0.8).  After RECUTS recuts any two blocks that are left are compared in full.

Defined results.  Null text is empty.  A text without words has an empty set and no links.  A text
with fewer words than a shingle is one shingle.  Null ids never are the smallest id unless a
component has no other.  Rows that share an id count as one vertex each by their text.  Equal rows
and ties share their class.  Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import broadcast_if_small, give_back, join_groups, own_names, ready_workers, release, text_digest, write_table

#: Rows of a band and bands: a pair of similarity 0.8 meets in a band but for 3 in a million.
BAND_ROWS, BANDS = 5, 32
#: Bands whose groups the first round reads.
FIRST_BANDS = 8
#: Bins of the packed signature and bits kept of each minimum.
BINS, LOW_BITS = 1024, 2
#: Round one, whose omissions round two makes good, leaves out pairs estimated this far under the threshold.
MARGIN = 0.06
#: The most probable loss of a link by round two's estimate, for each pair.
MISS = 1e-9
#: Rows of a block within a band group, the largest minority that goes to every block, and how often groups are recut.
BLOCK, MINORITY, RECUTS = 256, 512, 2
#: Sets up to this size also carry two bytes of every shingle, which bound what two of them share almost exactly.
SHORT = 256
#: Words whose hash a worker remembers.
MEMO_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, (1 + RECUTS, BAND_ROWS * BANDS), dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, (1 + RECUTS, BAND_ROWS * BANDS), dtype=np.uint64)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; only A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMO_WORDS:
        _words.clear()
    hashes = []
    for word in words:
        h = _words.get(word)
        if h is None:
            h = _words[word] = xxhash.xxh3_64_intdigest(word)
        hashes.append(h)
    a = np.array(hashes, np.uint64)
    with np.errstate(over="ignore"):
        n = len(a)
        if n < width:
            h = np.full(1, n, np.uint64)
            for x in a:
                h = _mix(h * _MIX ^ x)
            return h
        h = a[: n - width + 1]
        for k in range(1, width):
            h = _mix(h * _MIX ^ a[k : n - width + 1 + k])
    return np.unique(h)


def band_keys(shingles: np.ndarray, family: int = 0) -> np.ndarray:
    """One 64-bit key per band, from BAND_ROWS full minima each; families are independent."""
    low = np.full(BAND_ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            np.minimum(low, (shingles[k : k + 1024, None] * _A[family] + _B[family]).min(0), out=low)
        rows = (low >> np.uint64(32)).reshape(BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(BAND_ROWS):
            key = _mix(key * _MIX ^ rows[:, k])
    return key.view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """Bit planes over BINS bins: occupied, then the low bits of each bin's least hash."""
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(shingles), bool)
    first[1:] = bins[1:] != bins[:-1]  # sorted, so the first of a bin is its minimum
    planes = np.zeros((1 + LOW_BITS, BINS), np.uint8)
    at, least = bins[first], shingles[first]
    planes[0, at] = 1
    for k in range(LOW_BITS):
        planes[1 + k, at] = (least >> np.uint64(k)).astype(np.uint8) & 1
    return np.packbits(planes, axis=1).tobytes()


def unpack(sketches: list[bytes]) -> np.ndarray:
    """Sketches as 64-bit words: (planes, rows, words)."""
    size = (1 + LOW_BITS) * BINS // 8
    words = np.frombuffer(b"".join([s[:size] for s in sketches]), np.uint64)
    return words.reshape(len(sketches), 1 + LOW_BITS, BINS // 64).transpose(1, 0, 2)


def keys_in(sketches: list[bytes]) -> np.ndarray:
    """The band keys that describe() appends to a sketch: (rows, BANDS)."""
    size = (1 + LOW_BITS) * BINS // 8
    return np.frombuffer(b"".join([s[size : size + 8 * BANDS] for s in sketches]), np.int64).reshape(len(sketches), BANDS)


def short_form(shingles: np.ndarray) -> bytes:
    """Two bytes of every shingle of a small set, in order; nothing for others."""
    return np.sort(shingles.astype(np.uint16)).tobytes() if len(shingles) <= SHORT else b""


def shorts_in(sketches: list[bytes]) -> list[np.ndarray]:
    """What describe() appends after the band keys."""
    size = (1 + LOW_BITS) * BINS // 8 + 8 * BANDS
    return [np.frombuffer(s, np.uint16, offset=size) if len(s) > size else np.zeros(0, np.uint16) for s in sketches]


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two sets in short form can share, at most: equal shingles have equal forms."""
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one unpacked sketch (planes, words) to many, corrected for chance agreement."""
    both = one[0] & many[0]
    either = np.bitwise_count(one[0] | many[0]).sum(1, dtype=np.int64)
    differ = np.zeros_like(both)
    for k in range(1, 1 + LOW_BITS):
        differ |= one[k] ^ many[k]
    n_both = np.bitwise_count(both).sum(1, dtype=np.int64)
    agree = np.bitwise_count(both & ~differ).sum(1, dtype=np.int64)
    chance = 0.5**LOW_BITS
    return (agree - chance * n_both) / ((1 - chance) * np.maximum(either, 1))


def margins(threshold: float, bins: np.ndarray) -> np.ndarray:
    """How far under the threshold the estimate of a link may fall, but for a probability of MISS; bins are those either set occupies.

    A bin adds 1, 0 or -1/3 to the mean; the variance is at most that of a pair at the threshold.  By
    Bernstein's inequality (bins are drawn without replacement, which only narrows the tail) the
    deviation x satisfies bins * x**2 = 2 * log(1 / MISS) * (variance + 4/9 * x).
    """
    chance = 0.5**LOW_BITS
    t = max(threshold, 0.5)
    variance = t * (1 - t) + (1 - t) * chance / (1 - chance)
    k = -math.log(MISS) / np.maximum(bins, 1)
    step = k / (3 * (1 - chance))
    return step + np.sqrt(step**2 + 2 * k * variance)


def most_common(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """Shingles that one set can share with each of many, at most.

    A common shingle is the least of its bin in both sets, so that the bin agrees, or it is one of
    those that are not the least of their bin in one of the sets.
    """
    differ = np.zeros_like(one[0] & many[0])
    for k in range(1, 1 + LOW_BITS):
        differ |= one[k] ^ many[k]
    count = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
    return count(one[0] & many[0] & ~differ) + (n_one - count(one[0])) + (n_many - count(many[0]))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, cls (hash of the set, null if empty), bands, sketch, digest (of the text)."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("digest"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls long, bands array<long>, sketch binary, digest binary"

    def run(batches):
        for batch in batches:
            n, cls, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                keys = band_keys(s) if len(s) else None
                bands.append(keys)
                sketches.append(sketch(s) + keys.tobytes() + short_form(s) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary()), "digest": batch.column(2)})
        _words.clear()
        give_back()

    return rows.mapInArrow(run, schema)


def _forest(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _pairs_of_block(cls: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, sketches: list[bytes], band_at: int, threshold: float, forest: bool):
    """Candidate pairs (a, b) of one block whose labels differ and that may reach the threshold.

    A pair counts in the first band that it shares only, unless a forest is wanted.

    side says which rows meet: all of side 0; those of side 1 with those of 2 and 3; those of 3 with each other.
    forest: of the pairs estimated at threshold - MARGIN or more only a spanning forest of the most similar.
    """
    planes, keys, short = unpack(sketches), keys_in(sketches), shorts_in(sketches)
    a, b, value = [], [], []
    everything = np.arange(len(cls))
    apart = bool(side.any())
    for i in np.nonzero(side >= 2)[0] if apart else everything:
        js = everything[i + 1 :] if not apart else np.nonzero((side == 1) | ((side == 3) & (side[i] == 3) & (everything > i)))[0]
        ratio = np.minimum(n[i], n[js]) >= threshold * np.maximum(n[i], n[js]) - 1e-9
        js = js[(label[js] != label[i]) & ratio]
        if len(js):
            e = estimates(planes[:, i], planes[:, js])
            if forest:
                ok = e >= threshold - MARGIN
            else:
                either = np.bitwise_count(planes[0, i] | planes[0, js]).sum(1, dtype=np.int64)
                common = most_common(planes[:, i], planes[:, js], n[i], n[js])
                ok = (e >= threshold - margins(threshold, either)) & (common >= threshold * (n[i] + n[js] - common) - 1e-9)
                ok &= (keys[js] == keys[i]).argmax(1) == band_at
            js, e = js[ok], e[ok]
            if len(short[i]) and len(js):
                common = np.array([most_shared(short[i], short[j]) if len(short[j]) else min(n[i], n[j]) for j in js])
                ok = common >= threshold * (n[i] + n[js] - common) - 1e-9
                js, e = js[ok], e[ok]
            a += [i] * len(js)
            b += js.tolist()
            value += e.tolist()
    if forest and len(a) > 1:
        parent = {x: x for x in {*a, *b}}
        keep = []
        for k in sorted(range(len(a)), key=lambda k: (-value[k], min(cls[a[k]], cls[b[k]]), max(cls[a[k]], cls[b[k]]))):
            x, y = _forest(parent, a[k]), _forest(parent, b[k])
            if x != y:
                parent[x] = y
                keep.append(k)
        a, b = [a[k] for k in keep], [b[k] for k in keep]
    return np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])


def _candidates(members: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) from band groups; members has band, part, side, cls, n, label, sketch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list = []
        key = None

        def flush():
            if len(held) > 1:
                cls, n, label, side = (np.array([r[k] for r in held], np.int64) for k in range(4))
                if label.min() != label.max():
                    order = np.argsort(cls, kind="stable")
                    a, b = _pairs_of_block(cls[order], n[order], label[order], side[order], [held[k][4] for k in order], held[0][5], threshold, forest)
                    if len(a):
                        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
            return None

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for row in zip(*columns):
                if row[:2] != key:
                    out = flush()
                    if out is not None:
                        yield out
                    held, key = [], row[:2]
                held.append((row[3], row[4], row[5], row[2], row[6], row[7]))
        out = flush()
        if out is not None:
            yield out

    dealt = members.select("band", "part", "side", "cls", "n", "label", "sketch", "at").repartition("band", "part").sortWithinPartitions("band", "part")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _all_cuts(large: DataFrame) -> DataFrame:
    """Adds part and side: groups cut into blocks, each two of which meet."""
    cuts = F.ceil(F.col("group_rows") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls", "band"), F.col("cuts")).cast("int")
    spread = large.withColumn("cuts", cuts).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    part = F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return spread.withColumns({"part": part, "side": side}).drop("cuts", "mine", "other")


def _minority_everywhere(large: DataFrame) -> DataFrame:
    """Adds part and side: the largest component of a group is cut into blocks, and the others go to each of them."""
    cuts = F.ceil(F.col("major_rows") / BLOCK).cast("int")
    major = F.col("label") == F.col("major")
    mine = F.pmod(F.xxhash64("cls", "band"), cuts).cast("int")
    parts = F.when(major, F.array(mine)).otherwise(F.sequence(F.lit(0), cuts - 1))
    return large.withColumn("__parts", parts).withColumn("part", F.explode("__parts")).withColumn("part", F.col("part").cast("string")).withColumn("side", F.when(major, 1).when(F.col("part") == "0", 3).otherwise(2)).drop("__parts")


def _judged_groups(members: DataFrame, n_rows: int) -> DataFrame:
    """members of groups that hold several components, with group_rows, major (the largest component) and major_rows."""
    of_label = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("rows"))
    most = F.max(F.struct("rows", "label"))
    groups = of_label.groupBy("band").agg(F.sum("rows").alias("group_rows"), most["label"].alias("major"), most["rows"].alias("major_rows"))
    mixed = write_table(groups.filter("major_rows < group_rows"), "mixed")
    return join_groups(members, mixed, ["band"], "group_rows", n_rows)


def _finer(large: DataFrame, sets: DataFrame, family: int) -> DataFrame:
    """large with its groups recut by the bands of another family of minima, read from the full sets."""
    def run(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(x, np.uint64), family) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"cls": batch.column(0), "finer": pa.array(keys, pa.list_(pa.int64()))})

    wanted = broadcast_if_small(write_table(large.select("cls").distinct(), "recut"))
    keys = sets.join(wanted, "cls", "left_semi").select("cls", "shingles").mapInArrow(run, "cls long, finer array<long>")
    each = large.join(keys, "cls").select("cls", "n", "at", "label", "band", F.explode("finer").alias("finer"))
    return each.select("cls", "n", "at", "label", F.xxhash64("band", "finer").alias("band"))


def _blocks(known: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """Rows (band, part, side, cls, n, at, label) of the blocks that round two compares; known has band, cls, n, at, label."""
    columns, out = ["band", "part", "side", "cls", "n", "at", "label"], None
    for family in range(1, RECUTS + 2):
        judged = write_table(_judged_groups(known, n_rows), "judged")
        small, minority = F.col("group_rows") <= 2 * BLOCK, F.col("group_rows") - F.col("major_rows")
        whole = judged.filter(small).withColumns({"part": F.lit("0"), "side": F.lit(0)})
        lean = _minority_everywhere(judged.filter(~small & (minority <= MINORITY)))
        blocks = whole.select(columns).unionByName(lean.select(columns))
        out = blocks if out is None else out.unionByName(blocks)
        large = judged.filter(~small & (minority > MINORITY))
        if large.limit(1).count() == 0:
            return out
        if family > RECUTS:
            return out.unionByName(_all_cuts(large).select(columns))
        known = write_table(_finer(large, sets, family), "finer")
        n_rows = known.count()


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) for the rows in wanted (doc_id, digest), read again from their texts."""
    ids = broadcast_if_small(wanted).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).withColumn("__digest", text_digest(F.col("text")))
    rows = rows.join(ids, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            cls, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if len(s):
                    cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "shingles": pa.array(sets, pa.binary())})
        _words.clear()
        give_back()

    return write_table(rows.mapInArrow(run, "cls long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets satisfy 100 * intersection >= percent * union.  pairs is a written table."""
    pairs = broadcast_if_small(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    sets = sets.join(needed, "cls", "left_semi")
    right = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("of_b")), "b")
    full = right.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                joined = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                if 100 * common >= percent * (len(p) + len(q) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, cls, digest (of the text).

    Rows are linked where 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id reachable by links, and kept is true for that row.
    """
    threshold = percent / 100
    rows = write_table(describe(docs, id_col, text_col), "sketches")
    one = F.min(F.struct("doc_id", "digest"))
    classes = rows.filter("cls is not null").groupBy("cls").agg(one.alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = write_table(classes.select("cls", "n", "one.doc_id", "one.digest", "bands"), "classes")
    keys = write_table(classes.select("cls", "n", F.posexplode("bands").alias("at", "band")), "bands")
    n_keys = keys.count()
    groups = write_table(keys.groupBy("band").agg(F.count(F.lit(1)).alias("group_rows")).filter("group_rows > 1"), "groups")
    members = write_table(join_groups(keys, groups, ["band"], "group_rows", n_keys), "members")
    release(keys, groups)
    met = broadcast_if_small(write_table(members.select("cls").distinct(), "met"))
    wanted = write_table(classes.join(met, "cls", "left_semi").select("cls", "doc_id", "digest"), "wanted")
    release(classes)
    twice = _sets(docs, wanted.drop("cls"), id_col, text_col)
    sets = write_table(twice.dropDuplicates(["cls"]), "sets")
    release(twice)
    signs = write_table(rows.select("cls", "sketch").join(broadcast_if_small(wanted).select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "signs")

    first = members.filter(F.col("at") < FIRST_BANDS).withColumn("label", F.col("cls"))
    cut = F.when(F.col("group_rows") > BLOCK, F.pmod(F.xxhash64("cls", "band"), F.ceil(F.col("group_rows") / BLOCK))).otherwise(F.lit(0)).cast("string")
    pairs = _candidates(first.join(signs, "cls").withColumns({"part": cut, "side": F.lit(0)}), threshold, True)
    links = write_table(_confirmed(write_table(pairs, "pairs"), sets, percent), "links")
    labels = connected_components(links)

    known = write_table(members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", "n", "at", F.coalesce("label", "cls").alias("label")), "known")
    blocks = _blocks(known, sets, n_keys)
    more = _candidates(blocks.join(signs, "cls"), threshold, False)
    more = write_table(_confirmed(write_table(more, "pairs"), sets, percent), "links")
    labels = connected_components(links.unionByName(more), labels)
    release(members, wanted, sets, signs, known)

    per_class = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    named = per_class.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = write_table(named, "classes")
    smallest = write_table(named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes")), "components")
    of_class = write_table(join_groups(named, smallest, ["label"], "n_classes", n_keys).select("cls", "copies", "component_id"), "verdicts")
    slim = rows.select("doc_id", "n_shingles", "cls", "digest")
    full = join_groups(slim.filter("cls is not null"), of_class, ["cls"], "copies", rows.count()).select("doc_id", "n_shingles", "component_id", "cls", "digest")
    empty = slim.filter("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "cls", "digest")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "cls", "digest")


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component only, columns unchanged.  A row is judged by its id and text together."""
    drop, text = own_names(docs.columns, "drop", "text")
    verdicts = near_duplicates(docs, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(drop), F.col("digest").alias(text)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(drop)) & (text_digest(F.col(text_col)) == F.col(text))
    return docs.join(broadcast_if_small(write_table(verdicts, "dropped")), same, "left_anti").select(docs.columns)
