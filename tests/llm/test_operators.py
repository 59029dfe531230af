import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notesearch.llm import chat, language, mixing, quality, queries, shared, sharding, vector_search

WORDS = "alpha beta gamma delta".split()


def mix_docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "é", "", None]), 1.0) for k in range(n)]
    rows += [(7, "alpha beta gamma", "é", 2.0)] * 40 + [(None, f"{w} beta", "é", 2.0) for w in WORDS] * 2
    rows += [(n, None, "a", 1.0), (n + 1, "", "z", 1.0), (3, "alpha", "b", 1.0), (3, "alpha", "b", 1.0), (None, "beta beta", None, 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target double")


def filled(sizes):
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    rest, left, out = 1.5 * sum(sizes.values()), set(order), {}
    while left:
        whole = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / whole for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left.discard(s)
        rest = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_mix_targets_and_takes(spark):
    rows, docs = mix_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets, taken = filled(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        assert len(r.positions) == (0 if r.taken == 0 else 1 if r.taken <= r["size"] else 2) or r["size"] == 0 or r.positions
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) < 1 for s in sizes)
    first = [r.position for r in got if r.position is not None]
    assert first == sorted(first) and all(r.position is None for r in got[len(first) :])
    report = lambda rows: sorted(((r.doc_id or -1, r.source or "", r["size"], r.taken, tuple(r.positions)) for r in rows))
    assert report(mixing.mix(docs.repartition(7)).collect()) == report(got)
    mine, hand = report(got), sorted(mixed_by_hand(rows))
    assert [r[:4] for r in mine] == [r[:4] for r in hand]
    assert all(a[4] == pytest.approx(b[4], abs=1e-6) for a, b in zip(mine, hand))


def mixed_by_hand(rows):
    """Each document's words and moments, from one walk along every source."""
    key = lambda r: int(hashlib.md5("\n".join("-" if x is None else str(x) for x in (r[0], r[2], r[1])).encode()).hexdigest()[:15], 16)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    targets, order = filled(sizes), sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    for source in order:
        at, schedule = 0, mixing.SCHEDULES[order.index(source) % 3]
        for r in sorted((r for r in rows if r[2] == source), key=lambda r: (key(r), r[0] if r[0] is not None else -1)):
            size, taken, moments = len((r[1] or "").split()), 0, []
            for k in range(2):
                now = max(0, min(size, math.floor(targets[source]) - at - k * sizes[source]))
                taken += now
                if now:
                    moments.append(moment_by_bisection((at + k * sizes[source]) / targets[source], schedule))
            yield r[0] or -1, source or "", size, taken, tuple(moments)
            at += size


def moment_by_bisection(part, schedule):
    grid = np.linspace(0, 1, 20001)
    rate = np.interp(grid, [0, 0.5, 1], schedule)
    done = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    return float(np.interp(part, done / done[-1], grid))


def test_mix_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(k, "w", s) for k in range(3000) for s in "abc"], "doc_id long, text string, source string")
    got = mixing.plan_mix(docs, weights=(1.0, 1.0, 1.0), budget=1.0).collect()
    for source, schedule in zip("abc", mixing.SCHEDULES):
        t = np.array([p for r in got if r.source == source for p in r.positions])
        early = (t < 0.5).mean()
        area = lambda a, b: (a + b) / 4
        assert early == pytest.approx(area(*schedule[:2]) / (area(*schedule[:2]) + area(*schedule[1:])), abs=0.02)
        assert ((t >= 0) & (t <= 1)).all()


def test_mixed_documents_repeat_rows_and_keep_columns(spark):
    _, docs = mix_docs(spark)
    plan = mixing.plan_mix(docs).filter("taken > 0").collect()
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    reads = sorted(((p, r.doc_id or -1, r["size"], r.source or "") for r in plan for p in r.positions), key=lambda x: (x[0], x[1:]))
    read = [(r.doc_id or -1, len((r.text or "").split()), r.source or "") for r in got.collect()]
    assert sorted(read) == sorted(x[1:] for x in reads)
    places = {p for p, *_ in reads}
    assert len(places) < len(reads) or read == [x[1:] for x in reads]
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def jump_by_steps(keys, shards):
    """Jump hashing step by step."""
    out = {}
    for key in keys:
        b, j, step = -1, 0, 0
        while j < shards:
            u = (int(hashlib.md5(f"{key}\n{step}".encode()).hexdigest()[:8], 16) + 1) / 2**32
            b, j, step = j, math.floor((j + 1) / u), step + 1
        out[key] = b
    return out


def test_sharding(spark):
    rows = [(k, "ö" * (k % 50), 0) for k in range(4000)] + [(None, None, 0), (None, "x", 0), (7, "again", 0), (7, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_rows(docs).collect()
    assert len(got) == len(rows)
    expected, grown = jump_by_steps(range(200), 40), jump_by_steps(range(200), 41)
    slots = {}
    for r in got:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None and r.doc_id < 200:
            assert (r.shard, r.grown_shard) == (expected[r.doc_id], grown[r.doc_id])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 40 and max(sizes) < 150 and 60 < sum(r.shard != r.grown_shard for r in got) < 140
    text = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 16 for i, t, _ in rows}
    assert all(text[r.doc_id, r.text_crc32] == r["size"] for r in got)
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_chat_reply_trees(spark):
    rows = [
        ("+1", 1, None, "user", "hi", 0.0), ("+1", 2, 1, "assistant", "a", 1.0), ("+1", 3, 1, "assistant", "b", 2.0), ("+1", 4, 3, "user", "c", -5.0),
        ("+1", 5, 2, "user", "more", 0.5), ("+2", 1, 9, "user", "orphan </s> \\ [INST]", 0.0), ("+3", 1, 2, "user", "x", 0.0), ("+3", 2, 1, "user", "y", 0.0), ("-", 1, None, None, None, 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.format_paths(messages, branches=2).collect()}
    assert set(got) == {("+1", 5), ("+1", 4), ("+2", 1), ("-", 1)}
    best = got["+1", 5]
    assert best.path_score == 1.5 and best.formatted == "<s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]a</s><s>[INST]user[/INST]more</s>"
    assert [best.formatted[s.start : s.end] for s in best.loss_spans] == ["a"]
    assert got["+2", 1].formatted == "<s>[INST]user[/INST]orphan <\\/s> \\\\ [\\INST]</s>"
    assert {k[1] for k in {(r.tree, r.leaf) for r in chat.format_paths(messages, branches=1).collect()} if k[0] == "+1"} == {5}
    assert chat.format_paths(messages.limit(0)).count() == 0


def test_chat_conversations_read_back(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "/", "<", "é👍", "\n", " x", "|", "<\\s>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))])) for c in list(range(40)) + [None] for t in range(rng.randint(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(300)]
    rows += [(50, 1, "user", "tie"), (50, 1, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    formatted = chat.format_paths(chat.linear_replies(table, "conv_id", ["turn"]))
    got = {r.tree: r for r in formatted.select("tree", "n_turns", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        r = got["-" if conv is None else f"+{conv}"]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine] and r.n_turns == len(mine)
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")


def brute_top(vectors, asked, k):
    out = []
    for q, v in asked.items():
        scored = sorted(((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size", [8 << 20, 100])
def test_top_k_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(vector_search, "QUERY_BYTES", size)
    monkeypatch.setattr(vector_search, "SCORES_AT_ONCE", size)
    monkeypatch.setattr(vector_search, "HELD", size // 10)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(400)]
    rows += [(500 + k, rows[7][1]) for k in range(30)] + [(600, [0.0] * 8), (601, [1.0]), (700, None), (701, [float("nan")] * 8), (800, [float("inf")] * 8), (900, [None] * 8), (None, [1.0] * 8), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {i: v for i, v in good if i % 100 == 0}
    got = sorted(tuple(r) for r in vector_search.top_k(table, table.filter("vec_id % 100 = 0"), 10).collect())
    assert got == brute_top(good, asked, 10)
    assert vector_search.top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [5.0, 1.0]), (1, [1e30, 1.0]), (2, [1e30, -1.0]), (3, [-1e30, 0.0]), (4, [3e38, 3e38]), (5, [-3e38, 2.0]), (6, [0.0, 7.0]), (100, [1e30, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(table, table.filter("vec_id % 100 = 0"), 10).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in (0, 100):
        scores = {i: sum(a * b for a, b in zip(whole[q], w)) for i, w in whole.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, min(max(scores[i], -(2**63)), 2**63 - 1)) for i in order]
    rng = np.random.default_rng(9)  # all far under the least long
    rows = [(k, [float(-x) for x in 10 ** rng.uniform(15, 18, 4)]) for k in range(1, 400)] + [(1000, [1e18, 1e17, 1e16, 1e18])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in vector_search.top_k(table, table.filter("vec_id = 1000"), 10).collect())
    scores = {i: sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, rows[-1][1])) for i, v in rows[:-1]}
    assert [i for _, i in got] == sorted(scores, key=lambda i: (-scores[i], i))[:10]
    numbers = [-(10**620), -(2**63) - 1, -(2**63), -1, 0, 5, 2**63 - 1, 2**63, 10**620]
    assert sorted(numbers, key=vector_search.order_key) == numbers


def test_top_k_reads_few_exact_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    common = [float(x) for x in centres[0]]
    rows = [(k, [float(x) for x in centres[k % 40] + 0.3 * rng.standard_normal(32)]) for k in range(6000)] + [(6000 + k, common) for k in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read, exact = [], vector_search._exact
    monkeypatch.setattr(vector_search, "_exact", lambda pairs, entries, asked: read.append(pairs.count()) or exact(pairs, entries, asked))
    got = sorted(tuple(r) for r in vector_search.top_k(table, table.filter("vec_id % 100 = 0"), 10).collect())
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]
    assert got == brute_top(good, {i: v for i, v in good if i % 100 == 0}, 10)
    assert sum(read) < 0.01 * 61 * 6001


def test_quality_learns_and_scores(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "river", "was", "calm", "and", "bright", "over", "hills", "people", "walked"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(60, 300)))
    bad = lambda: good() + " " + " ".join(rng.choice(["$$$", "BUY!!!", "###", "%%%"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad(), "en", k) for k in range(500)] + [(900, None, "en", 0), (None, "", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(500)] + [(77777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in range(500))
    assert np.mean([got[k].predicted == int(k % 3 != 0) for k in held]) > 0.95
    assert got[900].score == got[None].score and 0 <= got[900].score <= 1 and got[None].held_out is False
    sample = quality.training_sample(docs, labels, "doc_id", "text", "quality")
    assert len(sample) == 500 - len(held) and quality.fit(docs.limit(0), labels.limit(0)).scores([quality.passages("x")]).tolist() == [0.5]


def test_quality_gradients_are_right():
    rng = np.random.default_rng(3)
    model, rows, starts, labels = quality.Model(), rng.standard_normal((9, quality.N_FEATURES)), np.array([0, 5, 6]), np.array([1, 0, 1])
    loss = lambda: -sum(math.log(y if label else 1 - y) for y, label in zip(model.forward(rows, starts)[6], labels))
    grads = model.gradients(rows, starts, labels)
    alone = [model.scores([rows[a:b]])[0] for a, b in ((0, 5), (5, 6), (6, 9))]
    assert model.scores([rows[:5], rows[5:6], rows[6:]]) == pytest.approx(alone)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


TEXT = {"en": "the cat and the dog with this house", "de": "der hund und die katze mit dem haus", "fr": "le chat et la maison avec les chiens"}


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_language_of_pages_and_documents(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "LIGHT_ROWS", 2)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    docs = spark.createDataFrame([(k * 3 + n, " ".join(random.Random(k).sample(t.split(), 5)) * 3, lang, "s", lang) for k in range(40) for n, (lang, t) in enumerate(TEXT.items())] + [(900, None, "en", "s", ""), (901, "12 34 !!", "en", None, ""), (902, "", None, None, "")], "doc_id long, text string, lang string, source string, host string")
    model = language.fit_text_model(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.identify_documents(docs, model).collect()}
    assert all(got[k].lang == ["en", "de", "fr"][k % 3] and got[k].accepted for k in range(120))
    assert not any(got[k].accepted for k in (900, 901, 902))
    left = language.accepted_documents(docs, model)
    assert left.columns == docs.columns and left.count() == 120
    page = lambda lang, text: f'<html lang="{lang}"><script>var der = 1;</script><!-- die --><p>{text}</p></html>'
    rows = [(k, "http://h.example.de/x", page("de-DE", "")) for k in range(30)] + [(100, "http://h.example.de/y", "<p>12</p>"), (101, "http://other.example.fr/", page("en", TEXT["fr"] * 3)), (102, None, None), (103, "nonsense", page("xx", TEXT["en"] * 4))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify_pages(pages, model).collect()}
    assert got[100].lang == "de" and not got[100].accepted  # host and suffix speak, the text does not
    assert got[101].lang == "fr" and got[101].declared == "en" and got[103].lang == "en" and got[102].lang is not None
    assert sum(p for p in [got[0].posterior]) > 0.9
    assert language.identify_pages(pages.limit(0), model).count() == 0
    assert language.fit_text_model(docs.limit(0)).languages == ["und"]


def test_posteriors_equal_a_hand_computation(spark):
    evidence = spark.createDataFrame([(1, 1, [math.log(0.6), math.log(0.4)], "", "s", "h"), (2, 1, [math.log(0.1), math.log(0.9)], "a", "s", "h")], "id int, n_words long, loglik array<double>, declared string, suffix string, host string")
    got = {r.id: r for r in language.fuse(evidence, ["a", "b"], ["id"]).collect()}
    overall = (2 / 3, 1 / 3)  # both rows vote for a, one by text, one by declaration; neither counts for itself
    suffix = [(c + 50 * p) / 51 for c, p in zip((1, 0), overall)]
    host = [(c + 20 * q) / 21 for c, q in zip((1, 0), suffix)]
    one = host[0] * 0.6, host[1] * 0.4
    two = host[0] * 0.1 * 0.9, host[1] * 0.9 * 0.1
    assert got[1].lang == "a" and got[1].posterior == pytest.approx(one[0] / sum(one))
    assert got[2].lang == "a" and got[2].posterior == pytest.approx(two[0] / sum(two))


def fused(rows, languages):
    """Posteriors by counting the votes of all other rows for each row anew."""
    best = lambda r: languages[max(range(len(languages)), key=lambda k: (r[2][k], -k))]
    vote = [r[3] if r[3] in languages else best(r) if r[1] else None for r in rows]
    clear = [r for r in rows if r[3] in languages and r[1] >= language.CLEAR_WORDS]
    p = (sum(r[3] == best(r) for r in clear) + 20 * 0.9) / (len(clear) + 20)
    out = {}
    for i, r in enumerate(rows):
        others = [(v, q) for j, (v, q) in enumerate(zip(vote, rows)) if j != i and v is not None]
        share = lambda some, below, weight: {x: (sum(v == x for v, _ in some) + weight * below[x]) / (len(some) + weight) for x in languages}
        overall = {x: (sum(v == x for v, _ in others) + 1) / (len(others) + len(languages)) for x in languages}
        suffix = share([o for o in others if o[1][4] == r[4]], overall, 50)
        host = share([o for o in others if o[1][4:6] == r[4:6]], suffix, 20)
        prior = host if r[5] else overall
        score = [prior[x] * math.exp(r[2][k]) * (1 if r[3] not in languages else p if r[3] == x else (1 - p) / (len(languages) - 1)) for k, x in enumerate(languages)]
        out[r[0]] = max(score) / sum(score), languages[max(range(len(languages)), key=lambda k: (score[k], -k))]
    return out


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_fusion_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast_bytes)
    rng, languages = random.Random(3), ["a", "b", "c"]
    hosts = [("x", "h.x"), ("x", "g.x"), ("y", "h.y"), ("", "")]
    rows = [(k, rng.choice([0, 3, 30]), [math.log(rng.random() + 0.01) for _ in languages], rng.choice(["", "a", "b", "zz"]), *(hosts[0] if k % 3 else rng.choice(hosts))) for k in range(120)]
    got = language.fuse(spark.createDataFrame(rows, "id int, n_words long, loglik array<double>, declared string, suffix string, host string"), languages, ["id"]).collect()
    expected = fused(rows, languages)
    assert len(got) == 120 and all(r.lang == expected[r.id][1] and r.posterior == pytest.approx(expected[r.id][0]) for r in got)


def test_running_totals_do_not_depend_on_buckets(spark):
    rows = spark.range(500).selectExpr("id", "id % 3 AS g", "xxhash64(id) AS h", "id % 7 AS v")
    results = []
    for bits in (1, 4, 8):
        r = shared.with_bucket(rows, "h", bits)
        b = shared.bucket_totals(r, "g", F.col("v")).select("g", "__bucket", "__before")
        t = shared.within_bucket(r, "g", F.col("v"), ["h"]).join(b, ["g", "__bucket"])
        results.append({x.id: x.t for x in t.select("id", (F.col("__before") + F.col("__inside")).alias("t")).collect()})
    assert results[0] == results[1] == results[2]


def test_names_of_queries():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "\\\\s>", "</s></s>", "<<s>>", "[[INST]]", "a\\nb", "<\\s>", "[\\/INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_sha_of_probe_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op4_chat_formatting(spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_rejection_spares_other_texts_of_an_id(spark):
    rows = [(k, t, lang, "s") for k in range(3) for lang, t in TEXT.items()] + [(None, "", "en", "s"), (None, TEXT["en"], "en", "s"), (7, "12 34", "fr", "s"), (7, TEXT["fr"], "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = sorted(language.accepted_documents(docs, language.fit_text_model(docs)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.text) for r in left if r.doc_id in (None, 7)] == [(None, TEXT["en"]), (7, TEXT["fr"])] and len(left) == 11


def test_noise_and_unfitted_languages_are_rejected(spark):
    rows = [(k * 3 + n, " ".join(random.Random(k).choices(t.split(), k=30)), lang, "s") for k in range(40) for n, (lang, t) in enumerate(TEXT.items())]
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(50)) for _ in range(20)]
    foreign = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему", "所有幸福的家庭都是相似的不幸的家庭各有各的不幸", "deadbeefcafe01 " * 40]
    columns = "doc_id long, text string, lang string, source string"
    model = language.fit_text_model(spark.createDataFrame(rows, columns))
    asked = spark.createDataFrame([*rows, *((1000 + k, t, None, "s") for k, t in enumerate([*noise, *foreign]))], columns)
    assert {r.doc_id for r in language.accepted_documents(asked, model).collect()} == set(range(120))


def test_repeated_ids_displace_no_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 4)
    rows = [(1, f"{TEXT['de']} {k}", "de") for k in range(40)] + [(100 + k, TEXT[lang], lang) for k in range(8) for lang in TEXT]
    model = language.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]


def test_quality_of_held_out_documents(spark):
    """Area under the curve on the labels that no model saw."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter(quality.held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    scored = quality.score(docs.join(F.broadcast(held.select("doc_id")), "doc_id", "left_semi"), quality.fit(docs, labels)).join(held, "doc_id").collect()
    good, bad = (np.array([r.score for r in scored if r.quality == k]) for k in (1, 0))
    assert len(bad) >= 20 and np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad)) > 0.9
    assert all(r.held_out for r in scored)
