import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notesearch.llm import components, exact_dedup, near_dedup, shared

ROWS = [
    (5, "a  b", 1), (3, "a\tb", 2), (9, "a b", 3), (4, None, 4), (7, "", 5), (8, "alone", 6), (8, "alone", 6), (None, "a b", 7), (None, "none", 8), (6, " ", 9), (2, "x " * 50_000, 10),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id int")


def test_exact_groups(spark):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.group_copies(docs_of(spark, ROWS)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        (5, sha("a b")): (3, 4, False), (3, sha("a b")): (3, 4, True), (9, sha("a b")): (3, 4, False), (None, sha("a b")): (3, 4, False),
        (4, sha("")): (4, 2, True), (7, sha("")): (4, 2, False), (8, sha("alone")): (8, 2, True), (None, sha("none")): (None, 1, True),
        (6, sha(" ")): (6, 1, True), (2, sha("x " * 50_000)): (2, 1, True),
    }
    assert exact_dedup.group_copies(docs_of(spark, ROWS)).count() == len(ROWS)
    assert exact_dedup.group_copies(docs_of(spark, ROWS).limit(0)).count() == 0


def test_exact_drop_keeps_columns_and_first_rows(spark):
    left = exact_dedup.drop_copies(docs_of(spark, ROWS))
    assert left.columns == ["doc_id", "text", "keep_id"]
    assert sorted((r.keep_id for r in left.collect())) in ([2, 4, 6, 8, 9, 10], [2, 4, 7, 8, 9, 10])


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_filter_never_misses_a_repeat_and_hot_groups_are_whole(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 700}", 0) for k in range(3000)]
    got = exact_dedup.group_copies(docs_of(spark, rows)).collect()
    first, size = {}, {}
    for k, t, _ in rows:
        first.setdefault(t, k)
        size[t] = size.get(t, 0) + 1
    text = {k: t for k, t, _ in rows}
    assert len(got) == 3000
    assert all((r.keep_id, r.group_size) == (first[text[r.doc_id]], size[text[r.doc_id]]) for r in got)


@pytest.mark.parametrize("rows", [2_000, 20_000, 2_000_000])
def test_filter_flags_few_unique_rows_at_any_size(spark, rows):
    prints = spark.range(rows).select(F.when(F.col("id") % 10 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    prints = shared.write_table(prints.select("doc_id", F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)).alias("digest")), "prints")
    blocks = exact_dedup.n_blocks(rows)
    flagged, maybe = exact_dedup.flag_repeats(prints, shared.write_table(exact_dedup.repeated_slots(prints, blocks), "bloom"), blocks, rows)
    hot, unique = flagged.agg(F.count_if(F.col(maybe) & (F.col("doc_id") == 7)), F.count_if(F.col(maybe) & (F.col("doc_id") != 7))).first()
    assert hot == rows // 10 + 1 and unique < 0.02 * rows


@pytest.mark.parametrize("broadcast_bytes", [0, shared.BROADCAST_BYTES])
def test_drop_without_repeats_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(k, f"alone {k}" if k % 3 else f"group{' ' * (1 + k % 2)}{k // 90}", "s") for k in range(600)] + [(None, "alone 1", "s"), (None, "lonely", None), (601, None, "s"), (602, "", "t")]
    least = {}
    for k, text, _ in rows:
        key = " ".join((text or "").split())
        least[key] = min((x for x in (least.get(key), k) if x is not None), default=None)
    want = [r for r in rows if r[0] == least[" ".join((r[1] or "").split())]]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, left), key=order) == sorted(want, key=order)


def test_columns_may_have_any_name(spark):
    rows = [(k, f"text {k % 7} of this small and simple kind", "a", "en", "d", "i", 1.0) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __digest0 string, __dropped0 string, __id0 string, __MAYBE0 double").withColumnsRenamed({})
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        left = drop(docs)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == list(range(7))


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_one_row_of_repeats_stays(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(1, "a b", "x")] * 50 + [(None, "c", "y"), (None, "c ", "z"), (None, "c  ", "z")] + [(2, "a  b", "x"), (3, "d", "x")]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in left) == [(0, "c"), (0, "c"), (1, "a"), (3, "d")]


def brute(texts, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = set() if not w else ({tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_texts(seed=3, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz é ñ".split()) + str(rng.randint(0, 60))
    bases = [[word() for _ in range(rng.randint(4, 120))] for _ in range(12)]
    texts = [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "One TWO"), (1005, "One  two three"), (1006, "É é"), (1007, "é é")]
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        texts.append((k, (" ", "\n")[k % 2].join(w)))
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = near_texts()
    got = near_dedup.near_duplicates(docs_of(spark, [(i, t, 0) for i, t in texts]), percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(texts, percent)


@pytest.mark.parametrize("minority", [1, 4, 1000])
def test_large_band_groups_are_cut_without_losing_links(spark, monkeypatch, minority):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MINORITY", minority)
    monkeypatch.setattr(shared, "LIGHT_ROWS", 2)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    texts = near_texts(9, 120)
    got = near_dedup.near_duplicates(docs_of(spark, [(i, t, 0) for i, t in texts]), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(texts, 85)


def test_near_edge_rows(spark):
    rows = [(None, "a b c d e f", 1), (4, "A b c d e f", 2), (4, "A b c d e f", 2), (9, "other words in this row", 3), (None, None, 4)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 1, 9, True), (None, 0, None, True)], key=str)
    assert near_dedup.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    left = near_dedup.drop_near_copies(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "keep_id"] and {r.doc_id for r in left.collect()} >= {4, 9}


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        common, a, b = (np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (800, 90, 60))
        x, y = (np.unique(np.concatenate([common, e])) for e in (a, b))
        planes = near_dedup.unpack([near_dedup.sketch(x), near_dedup.sketch(y)])
        errors.append(float(near_dedup.estimates(planes[:, 0], planes[:, 1:])[0]) - 800 / 950)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < near_dedup.MARGIN


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_components(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(shared, "LIGHT_ROWS", 1)
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (30, 31), (31, 32), (32, 33), (33, 34), (34, 5), (2, 1), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 5 for k in (5, 30, 31, 32, 33, 34)}}
    assert components.connected_components(links.limit(0)).count() == 0


def test_near_drop_spares_other_texts_of_an_id(spark):
    rows = [(None, "a b c d e f", 1), (4, "A b c d e f", 2), (None, "quite another text without any copy", 3), (None, None, 4), (7, "a b c d e f ", 5), (7, "the second text of a repeated id", 6)]
    assert sorted(r.keep_id for r in near_dedup.drop_near_copies(docs_of(spark, rows)).collect()) == [2, 3, 4, 6]


def test_short_links_that_the_sketch_underrates_are_found(spark):
    rng, texts = random.Random(11), []
    while len(texts) < 6:
        words = [str(rng.random()) for _ in range(11)]
        pair = [near_dedup.shingle_set(" ".join(w)) for w in (words, words[:10])]
        planes = near_dedup.unpack([near_dedup.sketch(s) for s in pair])
        if near_dedup.estimates(planes[:, 0], planes[:, 1:])[0] < 0.85 - near_dedup.MARGIN:
            texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join(words[:10]))]
    got = near_dedup.near_duplicates(docs_of(spark, [(i, t, 0) for i, t in texts]), 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_no_link_is_ruled_out():
    rng, zero = np.random.default_rng(5), np.zeros(2, np.int64)
    for n, common in [(2, 2), (5, 4), (6, 5), (10, 8), (50, 40), (300, 240), (2000, 1600)] * 150:
        whole = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets = [np.sort(whole), np.sort(whole[:common])]
        sketches = [near_dedup.sketch(s) + bytes(8 * near_dedup.BANDS) + near_dedup.short_form(s) for s in sets]
        a, b = near_dedup._pairs_of_block(np.arange(2), np.array([n, common]), np.arange(2), zero, sketches, 0, 0.8, False)
        assert (a.tolist(), b.tolist()) == ([0], [1])
    apart = [near_dedup.sketch(np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))) + bytes(8 * near_dedup.BANDS) for n in (6, 6, 900, 900)]
    a, _ = near_dedup._pairs_of_block(np.arange(4), np.array([6, 6, 900, 900]), np.arange(4), np.zeros(4, np.int64), apart, 0, 0.8, False)
    assert len(a) == 0


def test_a_common_passage_costs_in_proportion(spark, monkeypatch):
    """Texts that share a passage and nothing else: comparisons grow with the rows, not with their pairs."""
    monkeypatch.setattr(near_dedup, "MINORITY", 64)
    passage = " ".join(f"passage{k}" for k in range(40))
    texts = lambda n: [(k, passage + " " + " ".join(f"w{k}x{j}" for j in range(60)), k) for k in range(n)] + [(10**6 + k, passage + " " + " ".join(f"w{k}x{j}" for j in range(60)) + " more", 0) for k in range(5)]
    met = {}
    for n in (2000, 8000):
        docs = docs_of(spark, texts(n)).repartition(8)
        rows = near_dedup.describe(docs, "doc_id", "text")
        keys = shared.write_table(rows.select("cls", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("at", "band"), F.col("cls").alias("label")), "known")
        sets = near_dedup._sets(docs, rows.select("doc_id", "digest"), "doc_id", "text")
        blocks = near_dedup._blocks(keys, sets, 32 * n).groupBy("band", "part").agg(F.count_if(F.col("side") == 1).alias("one"), F.count_if(F.col("side") != 1).alias("two"), F.max("side").alias("side"))
        met[n] = blocks.agg(F.sum(F.when(F.col("side") == 0, F.col("two") * (F.col("two") - 1) / 2).otherwise(F.col("two") * (F.col("one") + F.col("two") / 2)))).first()[0]
    assert met[8000] < 6 * met[2000], met
    got = near_dedup.near_duplicates(docs_of(spark, texts(2000)), 85)
    assert got.filter("doc_id <> component_id").count() == 5 and got.count() == 2005
