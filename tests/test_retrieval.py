import random

import pytest
from pyspark.sql import functions as F

from notesearch.functions import codecs
from notesearch.functions.text import escape_html, grams, hamming, like_pattern, longest_edit, query_words, term_grams, tokens, url_parameters, vbyte_size
from notesearch.operators import compress, correct, evaluate, expand, parse, search, similarity
from notesearch.operators.expand import ALWAYS, FALLBACK, NEVER
from notesearch.operators.index import build_index
from notesearch.plans.corpora import query_table, word_table

# The page, shop lines and small corpora of the published fixtures, with their expected results.
PAGE = """DESTINATAR 006220. Pg 1/1 03/02/2026 Vendita
001519 - 078 LUOGO DI DESTINAZION
20025 LEGNANO CORSO RICCI, 211R
Rif. citato in fatt. VEND 006893 del 03/02/2026
937518 XIAO BHR9917GL SMART WATCH 1.47" BT SMART BAND 9 ACTIVE PINK 2
949834 i BRON AMICOUNICOPIUBLACK CELL. QB 2" D.SIM BT TASTO SOS 1.3MP+ 6
|. | 944328 JBL JBLGOES2BLUEU MINI SPEAKER 2 BLUE 2
962849 ZIE. BLADEAS5BLACKBUDS2BUNDLE SMARTP.6.75"4GB 128GB A55S. i _. 6
17100 SAVONA SV
"""


def index_of(spark, texts):
    return build_index(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"))


def docs(df):
    return [r.doc for r in df.orderBy(*(["rank"] if "rank" in df.columns else ["doc"])).collect()]


def ask(spark, text):
    return query_table(spark, [(1, text)])


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


# --- parsing


def test_page(spark):
    notes = spark.createDataFrame([("n", PAGE), ("empty", "nothing here\n\nat all"), ("blank", "")], "doc_id string, text string")
    rows = parse.articles(notes).orderBy("pos").collect()
    assert [r.code for r in rows] == ["937518", "949834", "944328", "962849"]
    assert rows[1].descr == 'BRON AMICOUNICOPIUBLACK CELL. QB 2" D.SIM BT TASTO SOS 1.3MP+ 6'
    assert rows[3].descr == 'ZIE BLADEAS5BLACKBUDS2BUNDLE SMARTP.6.75"4GB 128GB A55S. 6'
    assert (rows[0].number, rows[0].date) == ("006220", "03/02/2026")
    bad = parse.rejects(notes).orderBy("doc_id", "pos").collect()
    assert [r.reason for r in bad if r.doc_id == "n"] == ["intestazione_documento", "luogo_destinazione", "indirizzo", "riferimento_fattura_ordine", "indirizzo"]
    assert [(r.reason, r.text) for r in bad if r.doc_id == "empty"] == [("documento_senza_righe_articolo", "(2 righe, layout non gestito)")]
    assert tuple(parse.build_counters(notes).first()) == (1, 0, 2, 4, 5)


def test_description_of_noise_only_keeps_the_brand(spark):
    notes = spark.createDataFrame([("n", "937518 XIAO __ i l |")], "doc_id string, text string")
    assert parse.articles(notes).first().descr == "XIAO "


def test_header_may_span_lines_and_lines_are_stripped(spark):
    notes = spark.createDataFrame([("n", "006220\nPg 1/1\n03/02/2026\f 937518 ABC X ")], "doc_id string, text string")
    row = parse.articles(notes).first()
    assert (row.number, row.date, row.descr) == ("006220", "03/02/2026", "ABC X")


# --- tokens and expansion


def test_tokens(spark):
    assert one(spark, tokens, "Vite zincata, 8x40 mm") == ["vite", "zincata", "8x40", "mm"]
    assert one(spark, tokens, "a_b ½²Ⅷ Perché") == ["a", "b", "perché"]
    assert one(spark, tokens, "b\U0001d4b3c \U0001f600x9 \U00020000") == ["b", "c", "x9"]  # beyond U+FFFF all characters separate
    assert one(spark, query_words, "  Lava*  7KG, ") == ["lava*", "7kg,"]


def test_grams_and_patterns(spark):
    assert one(spark, grams, "ab") == [] and one(spark, grams, "abcd") == ["abc", "bcd"]
    assert one(spark, like_pattern, "a%_\\*b") == "a\\%\\_\\\\%b"
    assert one(spark, lambda c: hamming(c, F.lit("0o0o")), "o0o0") == 4
    assert one(spark, lambda c: F.levenshtein(c, F.lit("sitting")), "kitten") == 3


SHOP = ["TV LED 55 UHD SMART", "LAVATRICE 7KG SLIM", "LAVASTOVIGLIE 13COP", "CUFFIA AURIC BT TASTO"]


@pytest.mark.parametrize("query, mode, found", [("lava*", NEVER, [1, 2]), ("*trice", NEVER, [1]), ("l*glie", NEVER, [2]), ("*av*", NEVER, [1, 2]), ("zz*", NEVER, []), ("*", NEVER, [0, 1, 2, 3]), ("tasta", FALLBACK, [3]), ("tasta", NEVER, []), ("lavatrice 7kq", FALLBACK, [1]), ("7kg,", NEVER, []), ("7kg,", FALLBACK, [1]), ("tasto", ALWAYS, [3]), ("qqq", ALWAYS, []), ("", FALLBACK, []), ("lavatrice qqq", FALLBACK, [])])
def test_search(spark, query, mode, found):
    assert docs(search.search(index_of(spark, SHOP), ask(spark, query), mode)) == found


def test_patterns_expand_in_every_mode(spark):
    index = index_of(spark, SHOP)
    words = expand.words_of(ask(spark, "lava* tasto tasta"))
    got = {m: sorted((r.word, r.term) for r in expand.expand(words, index.terms, m).collect()) for m in (NEVER, FALLBACK, ALWAYS)}
    wild = [("lava*", "lavastoviglie"), ("lava*", "lavatrice")]
    assert got[NEVER] == wild + [("tasto", "tasto")]
    assert got[FALLBACK] == got[ALWAYS] == wild + [("tasta", "tasto"), ("tasto", "tasto")]


def test_wildcards_take_marks_literally(spark):
    index = index_of(spark, ["ab axb"])
    for pattern, terms in (("a_b", []), ("a%", []), ("a*b", ["ab", "axb"]), ("ab", ["ab"]), ("a*b*b", []), ("$ab", [])):
        assert sorted(r.term for r in expand.wildcard(word_table(spark, [pattern]), index.terms).collect()) == terms


def test_boolean_index(spark):
    index = index_of(spark, ["Vite zincata 8x40 mm", "Rondella zincata 8 mm", "Vite inox 8x40"])
    assert docs(index.postings_of("zincata")) == [0, 1]
    assert docs(search.search_tokens(index, ask(spark, "Vite, zincata!"))) == [0]
    assert docs(search.search_tokens(index, ask(spark, "vite rondella"))) == []
    assert docs(search.search_any(index, ask(spark, "vite rondella"))) == [0, 1, 2]
    assert [r.word for r in index.contains(word_table(spark, ["vite", "x"])).collect()] == ["vite"]


# --- ranking


def test_ranking_by_hand(spark):
    index = index_of(spark, ["a a b", "a c", "b c c c"])
    assert index.corpus_stats.first().avgdl == 3.0
    score = lambda q, m, every=False: {r.doc: r.score for r in search.search_ranked(index, ask(spark, q), m, every, NEVER).collect()}
    assert score("b", search.BM25) == pytest.approx({0: 0.4700, 2: 0.4136}, abs=1e-3)
    assert score("c", search.TFIDF) == pytest.approx({1: 0.2867, 2: 0.3660}, abs=1e-3)
    order = lambda q, m, every: docs(search.search_ranked(index, ask(spark, q), m, every, NEVER))
    assert order("a c", search.BM25, True) == [1]
    assert order("c", search.TFIDF, False) == [2, 1]
    assert order("b", search.BM25, False) == order("b", search.NO_SCORE, False) == [0, 2]
    assert set(order("a c", search.BM25, False)) == {0, 1, 2}
    assert score("c c", search.BM25) == score("c", search.BM25)  # a repeated word scores once


def test_shared_terms_score_once_and_answer_for_both_words(spark):
    index = index_of(spark, ["lavatrice slim", "lavatrice", "slim"])
    both = search.search_ranked(index, ask(spark, "lava* *trice"), search.BM25, True, NEVER)
    plain = search.search_ranked(index, ask(spark, "lavatrice"), search.BM25, True, NEVER)
    assert both.orderBy("rank").collect() == plain.orderBy("rank").collect()
    everywhere = index_of(spark, ["a", "a"])
    assert [(r.doc, r.score) for r in search.search_ranked(everywhere, ask(spark, "a"), search.TFIDF, False, NEVER).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]


def test_top_k(spark):
    index = index_of(spark, ["a"] * 30)
    got = search.top_k(index, ask(spark, "a"), 10, model=search.BM25)
    assert docs(got) == list(range(10)) and got.first().text == "a"


# --- correction


def test_corrections(spark):
    texts = ["PEN DRIVE 16GB CRUZER", "PEN DRIVE 16GB BLADE", "PEN DRIVE 16GB GLIDE", "PEN DRIVE 166B CRUZER", "PEN DRIVE 8GB CRUZER", "PEN DRIVE 6GB CRUZER"]
    index = index_of(spark, texts)
    assert [(r.term, r.fixed) for r in correct.corrections(index.terms).collect()] == [("166b", "16gb")]
    fixed = correct.corrected_index(index)
    assert docs(fixed.postings_of("16gb")) == [0, 1, 2, 3] and docs(fixed.postings_of("166b")) == []
    assert correct.corrections(index_of(spark, ["it 50 a", "it 50 a", "1t 5o 4"]).terms).count() == 0


def test_correction_is_one_step_with_alphabetical_ties(spark):
    terms = spark.createDataFrame([("so0o", 1), ("sooo", 2), ("5ooo", 3), ("gg11", 1), ("g611", 2), ("gg1i", 2), ("bbbb", 5), ("bbb8", 5)], "term string, df long")
    got = {r.term: r.fixed for r in correct.corrections(terms).collect()}
    assert got == {"so0o": "5ooo", "sooo": "5ooo", "gg11": "g611"}
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "term string, fixed string")
    index = build_index(spark.createDataFrame([(0, "a b")], "doc long, text string"), chain)
    assert sorted((r.term, r.tf) for r in index.postings.collect()) == [("b", 1), ("c", 1)]


def test_correction_eval(spark):
    lines = spark.createDataFrame([(k, "000001", "BR ab8d1234 x") for k in range(3)] + [(9, "000001", "BR abbd1234 x"), (10, "000002", "BR zz01 q"), (11, "000002", "BR zz0l q")], "doc long, code string, descr string")
    terms = build_index(lines.select("doc", F.concat_ws(" ", "code", "descr").alias("text"))).terms
    assert tuple(correct.correction_eval(lines, terms).first()) == (1, 1, 0, 0, 2, 1)


# --- compression


def test_variable_bytes():
    numbers = [0, 1, 127, 128, 300, 16384, 16385, 2000000, 1073741823]
    assert codecs.vbyte_numbers(codecs.vbyte_bytes(numbers)) == numbers
    gaps = [16, 62, 42, 36, 79, 17, 44, 182, 35, 44, 18, 53]
    assert codecs.vbyte_bytes(gaps).hex(" ").upper() == "90 BE AA A4 CF 91 AC 36 81 A3 AC 92 B5"
    rng = random.Random(7)
    ids = sorted(rng.sample(range(1 << 30), 2000))
    assert codecs.running(codecs.vbyte_numbers(codecs.vbyte_bytes(codecs.gaps(ids)))) == ids


def test_front_coding():
    terms = sorted(["a", "aria", "a..abcde".replace(".", ""), "lava", "lavatrice", "perché", "perchè", "è", "zeta", "x" * 300, "x" * 299 + "y"], key=lambda t: t.encode())
    assert codecs.front_decoded(codecs.front_coded(terms)) == terms


def test_skips_find_no_more_work():
    rng = random.Random(1)
    skip = linear = 0
    for _ in range(200):
        a, b = (sorted(rng.sample(range(100_000), n)) for n in (20, 5000))
        skip += codecs.skip_comparisons(a, b)
        end = min(a[-1], b[-1])
        linear += sum(x <= end for x in a + b) - len(set(a) & set(b))
    assert 0 < skip < linear


def merge_cost(a, b):
    i = j = n = 0
    while i < len(a) and j < len(b):
        n += 1
        i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
    return n


def test_linear_cost_equals_a_merge(spark):
    rng = random.Random(2)
    lists = {t: sorted(rng.sample(range(60), rng.randint(0, 30))) for t in "abcdef"}
    texts = [" ".join(t for t in lists if d in lists[t]) for d in range(60)]
    pairs = [(f"{x}{y}", x, y) for x in lists for y in lists if x != y] + [("a?", "a", "absent")]
    got = {r.pair_id: (r.common, r.linear_cost) for r in search.intersections(index_of(spark, texts), spark.createDataFrame(pairs, "pair_id string, a string, b string")).collect()}
    lists["absent"] = []
    assert got == {k: (len(set(lists[x]) & set(lists[y])), merge_cost(lists[x], lists[y])) for k, x, y in pairs}


def test_packed_index_equals_plain(spark):
    rng = random.Random(3)
    index = index_of(spark, [" ".join(rng.choice("aria lava perché è 8gb zz tv frigo".split()) for _ in range(6)) for _ in range(500)])
    assert sorted(map(tuple, compress.unpacked(compress.packed(index.postings)).collect())) == sorted(map(tuple, index.postings.collect()))
    assert sorted(r.term for r in compress.unpacked_dictionary(compress.packed_dictionary(index.terms)).collect()) == sorted(r.term for r in index.terms.collect())
    size = sum(len(r.data) for r in compress.packed_dictionary(index.terms).collect())
    assert size == compress.front_coding(index.terms).agg(F.sum("coded_bytes")).first()[0]
    sizes = {r.term: len(r.docs) for r in compress.packed(index.postings).collect()}
    assert sizes == {r.term: r.gap_bytes for r in compress.vbyte_sizes(index.postings).collect()}
    ids = {r.word: r.id for r in compress.term_id(index.terms, word_table(spark, ["8gb", "è", "lavax"])).collect()}
    assert ids["8gb"] == 0 and ids["lavax"] == -1 and ids["è"] == 7


def test_dense_numbers(spark):
    got = compress.numbered(spark.range(1000).selectExpr("id * 7 % 1000 AS k"), "k").collect()
    assert all(r.k == r.number for r in got)
    sizes = spark.createDataFrame([(n,) for n in (0, 127, 128, 16383, 16384, 2**21, 2**28, 2**40)], "n long").select(vbyte_size(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == [1, 1, 2, 2, 3, 4, 5, 6]


# --- evaluation


def test_set_measures(spark):
    index = index_of(spark, ["vite zincata", "vite inox", "rondella inox", "dado"])
    queries = spark.createDataFrame([(1, "vite", False), (2, "zzz", True)], "query_id int, text string, has_variants boolean")
    qrels = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "query_id int, doc long")
    m = {r.query_id: r for r in evaluate.set_measures(search.search(index, queries, NEVER), queries, qrels, index.corpus_stats).collect()}
    assert tuple(m[1])[2:] == (0.5, 0.5, 0.5, 0.5) and tuple(m[2])[2:] == (0.0, 0.0, 0.0, 0.75)
    assert [(r.subset, r.n, r.precision) for r in evaluate.averages(evaluate.set_measures(search.search(index, queries, NEVER), queries, qrels, index.corpus_stats), "x").collect()] == [("all", 2, 0.25), ("variants", 1, 0.0)]


def test_rank_measures(spark):
    ranked = spark.createDataFrame([(1, 1, 0, 0.0), (1, 2, 1, 0.0), (2, 1, 5, 0.0), (2, 2, 6, 0.0)], "query_id int, rank int, doc long, score double")
    queries = spark.createDataFrame([(1, "", False), (2, "", False), (3, "", False)], "query_id int, text string, has_variants boolean")
    qrels = spark.createDataFrame([(1, 0), (1, 2), (2, 6), (3, 1)], "query_id int, doc long")
    got = {r.query_id: tuple(r)[2:] for r in evaluate.rank_measures(ranked, queries, qrels).collect()}
    assert got == {1: (0.5, 1.0, 0.5), 2: (0.5, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_known_items(spark):
    rows = [(0, "000001", "BR MODEL12 SMALL 1"), (1, "000001", "BR MODEL12 SMALL 1"), (2, "000001", "BR M0DEL12 SMALL 1"), (3, "000002", "BR ABCDEF X 1"), (4, "000003", "BR ABC X 1"), (5, "000003", "BR ABC X 1")]
    got = evaluate.known_items(spark.createDataFrame(rows, "doc long, code string, descr string")).collect()
    assert [tuple(r) for r in got] == [("000001", "model12 small", "model*", True)]


def test_efficiency_by_hand(spark):
    rows = [(d, f"{d % 7:06}", f"BR MODEL{d % 7}X {'SMALL' if d % 3 else 'LARGE'} 1") for d in range(60)]
    lines = spark.createDataFrame(rows, "doc long, code string, descr string")
    index = build_index(lines.select("doc", F.concat_ws(" ", "code", "descr").alias("text")))
    lists = {}
    for p in index.postings.collect():
        lists.setdefault(p.term, []).append(p.doc)
    lists = {t: sorted(x) for t, x in lists.items()}
    top = min(lists, key=lambda t: (-len(lists[t]), t))
    pairs = [i.exact.split(" ") for i in evaluate.known_items(lines).collect()]
    want = {}
    for name, each in (("query terms", pairs), ("most frequent", [(a, top) for a, _ in pairs])):
        want[name] = (len(each), sum(merge_cost(lists[a], lists[b]) for a, b in each), sum(codecs.skip_comparisons(lists[a], lists[b]) for a, b in each))
    assert {r.workload: (r.n_queries, r.linear, r.skip) for r in evaluate.efficiency(index, lines).collect()} == want
    absent = spark.createDataFrame([(1, "model1x", "nowhere")], "pair_id int, a string, b string")
    assert tuple(search.skip_costs(index, absent).first()) == (1, 0)


def test_matrix_with_vectors_has_one_more_system(spark):
    rows = [(d, f"{d % 3:06}", f"BR MODEL{d % 3}X SMALL 1") for d in range(9)]
    lines = spark.createDataFrame(rows, "doc long, code string, descr string")
    index = build_index(lines.select("doc", F.concat_ws(" ", "code", "descr").alias("text")))
    got = evaluate.set_matrix(index, correct.corrected_index(index), lines, similarity.hashed_vectors(index.terms)).collect()
    assert len(got) == 16 and {r.system for r in got if r.subset == "all"} >= {"exact", "vector neighbours"}


# --- similarity, escaping


def test_neighbours_in_blocks_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vecs = {k: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for k in range(120)}  # few directions, so many ties
    vectors = similarity.normalised(spark.createDataFrame(list(vecs.items()), "vec_id int, vec array<double>").repartition(5))
    unit = {r.vec_id: r.vec for r in vectors.collect()}
    want = []
    for q in range(0, 120, 3):
        near = sorted((-round(sum(x * y for x, y in zip(unit[q], unit[k])), 6), k) for k in unit)
        want += [(q, k, -c) for c, k in near[:5] if -c >= 0.3]
    asked = vectors.filter("vec_id % 3 = 0").select("vec_id")
    for block in (similarity.BLOCK_BYTES, 100):
        monkeypatch.setattr(similarity, "BLOCK_BYTES", block)
        assert sorted((r.asked, r.neighbour, r.cosine) for r in similarity.neighbours(asked, vectors, "vec_id", 5, 0.3).collect()) == sorted(want)
    assert similarity.neighbours(asked.filter("false"), vectors, "vec_id").collect() == []


def test_a_term_is_its_own_neighbour(spark):
    index = index_of(spark, ["friggitrice aria 1800w nero", "lavatrice slim 7kg bianco"] * 20)
    for vectors in (similarity.hashed_vectors(index.terms), similarity.trained_vectors(index.docs, 10)):
        near = similarity.neighbours(index.terms, vectors)
        assert {r.asked for r in near.filter("asked = neighbour").collect()} == {r.term for r in index.terms.collect()}
        assert 1 in docs(similarity.search_neighbours(index, ask(spark, "lavatrice 7kg"), vectors))


def test_escaping(spark):
    assert one(spark, escape_html, '<b a="1">&amp;') == "&lt;b a=&quot;1&quot;&gt;&amp;amp;"
    assert [tuple(p) for p in one(spark, url_parameters, "q=lava%2A&ocr=1&=x&y&z=a=b")] == [("q", "lava*"), ("ocr", "1"), ("z", "a=b")]


def test_pages_that_share_a_doc_id_count_as_sql_counts_them(spark):
    import duckdb

    from notesearch.oracles import oracle_sql

    orders = [100000, 100001, 1000000, 1000001, 1000007]  # the number of an order is cut to six digits
    rows = [(order, 1 + k, k) for order in orders for k in range(order % 3 + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr("*", "1.0D AS l_quantity").createOrReplaceTempView("shared_lineitem")
    duck, (lineitem, part) = duckdb.connect(), (spark.table("shared_lineitem").toPandas(), spark.createDataFrame([(k, f"red rod {k}") for k in range(3)], "p_partkey long, p_name string").toPandas())  # noqa: F841
    sql = oracle_sql()["build_counters"]
    want = duck.execute(sql)
    names, want = [d[0] for d in want.description], want.fetchone()
    pages = spark.createDataFrame([tuple(r) for r in duck.execute(sql[: sql.index("heads AS")].rstrip().rstrip(",") + " SELECT doc_id, text FROM notes").fetchall()], "doc_id string, text string")
    assert pages.count() > pages.select("doc_id").distinct().count()
    assert tuple(parse.build_counters(pages).select(*names).first()) == want


def test_skip_costs_from_places_follow_the_lists():
    rng = random.Random(11)
    for _ in range(3000):
        span = rng.choice([5, 40, 900])
        a, b = (sorted(rng.sample(range(span), rng.randint(1, span))) for _ in range(2))
        a = a[: rng.choice([1, 3, len(a)])]
        places = [2 * sum(x < d for x in b) + (d in b) for d in a]
        assert codecs.skip_comparisons_at(places, len(b)) == codecs.skip_comparisons(a, b)


def test_skip_costs_repeat_no_frequent_list(spark):
    texts = [f"all {'odd' if d % 2 else 'even'} m{d % 97}" for d in range(3000)]
    index = index_of(spark, texts)
    lists = {}
    for d, text in enumerate(texts):
        for term in text.split():
            lists.setdefault(term, []).append(d)
    pairs = [(f"{a} {b}", a, b) for a in lists for b in ("all", "odd", "none", "m3")]
    asked = spark.createDataFrame(pairs, "pair_id string, a string, b string")
    costs = search.skip_costs(index, asked)
    assert {r.pair_id: r.skip_cost for r in costs.collect()} == {name: codecs.skip_comparisons(lists[a], lists.get(b, [])) for name, a, b in pairs}
    named = build_index(index.docs.select(F.format_string("n%05d", "doc").alias("doc"), "text"))
    assert sorted(search.skip_costs(named, asked).collect()) == sorted(costs.collect())


def test_near_spellings_are_those_of_a_full_comparison(spark):
    rng = random.Random(3)

    def changed(word):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "a", "b1"]) + word[at + rng.randint(0, 1) :]
        return word or "a"

    base = ["".join(rng.choice("ab1") for _ in range(n)) for n in [1, 2, 3, 4, 5, 8, 11, 12, 13, 14, 15, 19, 30] for _ in range(3)]
    words, terms = (sorted({changed(rng.choice(base)) for _ in range(200)}) for _ in range(2))
    asked, known = word_table(spark, words), spark.createDataFrame([(t,) for t in terms], "term string")
    both = asked.crossJoin(known).withColumns({"w": term_grams(F.col("word")), "t": term_grams(F.col("term")), "distance": F.levenshtein("word", "term")})
    both = both.filter(F.col("distance") <= longest_edit(F.col("word"))).withColumn("common", F.size(F.array_intersect("w", "t")))
    want = both.withColumn("similarity", F.col("common") / F.size(F.array_union("w", "t"))).filter("common > 0 AND similarity >= 0.2")
    want = sorted(tuple(r) for r in want.select("word", "term", "similarity", "distance").collect())
    assert {len(word) for word, *_ in want} >= {4, 5, 12, 13, 14, 30}
    assert sorted(tuple(r) for r in expand.fuzzy(asked, known).collect()) == want


def test_patterns_of_every_kind(spark):
    import fnmatch

    terms = sorted({"".join(random.Random(k).choices("abé%_", k=k % 6 + 1)) for k in range(300)})
    patterns = ["a*", "*b", "ab*a", "a*ba", "*", "*é*", "**", "%*", "*_", "a*b*", "aba", "é%*_", "aaaaaaaaa*"]
    got = expand.wildcard(word_table(spark, patterns), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted((r.word, r.term) for r in got) == sorted((p, t) for p in patterns for t in terms if fnmatch.fnmatchcase(t, p))


def test_ranks_of_some_documents_are_those_of_the_whole_search(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["all", "of", "the", "few"] if rng.random() < 0.7 else [f"w{rng.randrange(20)}"]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    index = index_of(spark, texts)
    asked = ["all", "all of", "of all the", "w1", "w1 all", "w2 all", "w3 of all", "w3 of all w1", "none all", "none", "w1 w2", "w* the", "the few", ""]
    queries = query_table(spark, list(enumerate(asked)))
    docs = spark.createDataFrame([(q, d) for q in range(len(asked)) for d in range(len(texts)) if rng.random() < 0.3], "query_id int, doc long")
    for model in (search.NO_SCORE, search.TFIDF, search.BM25):
        want = search.search_ranked(index, queries, model, False, NEVER).join(docs, ["query_id", "doc"], "left_semi")
        want = sorted(tuple(r) for r in want.select("query_id", "rank", "doc", "score").collect())
        for frequent in (15, 10**6):
            assert sorted(tuple(r) for r in search.ranks_of(index, queries, docs, model, NEVER, frequent=frequent).collect()) == want


def test_every_word_is_looked_up_in_the_documents_of_the_rarest(spark):
    texts = [f"all m{d % 50} {'odd' if d % 2 else 'even'}" for d in range(500)]
    index = index_of(spark, texts)
    queries = query_table(spark, [(k, f"all m{k}") for k in range(50)] + [(50, "m1 odd all"), (51, "m2 odd"), (52, "none all"), (53, "m1* odd"), (54, "all")])
    want = [(k, d) for k in range(50) for d in range(500) if d % 50 == k] + [(50, d) for d in range(1, 500, 50)]
    want += [(53, d) for d in range(500) if d % 2 and str(d % 50).startswith("1")] + [(54, d) for d in range(500)]
    assert sorted(tuple(r) for r in search.search(index, queries, NEVER).collect()) == sorted(want)
    words = expand.words_of(queries)
    rows = search._met_words(index, words, expand.expand(words, index.terms, NEVER))
    assert rows.filter("query_id < 50").count() == 2 * 500  # not the 500 documents of `all` for each query
    assert sorted((r.query_id, r.doc) for r in search.search_ranked(index, queries, mode=NEVER).collect()) == sorted(want)


def test_search_over_neighbours_repeats_no_frequent_list(spark, monkeypatch):
    index = index_of(spark, [f"all m{d % 50}" for d in range(500)])
    queries, seen, met = query_table(spark, [(k, f"all m{k}") for k in range(50)]), [], search._met_words
    monkeypatch.setattr(search, "_met_words", lambda *given: seen.append(met(*given)) or seen[-1])
    terms = sorted(r.term for r in index.terms.collect())
    vectors = spark.createDataFrame([(t, [float(k == j) for j in range(len(terms))]) for k, t in enumerate(terms)], "term string, vec array<double>")
    found = similarity.search_neighbours(index, queries, vectors)
    assert sorted(tuple(r) for r in found.collect()) == [(k, d) for k in range(50) for d in range(500) if d % 50 == k]
    assert seen[0].count() == 2 * 500


def test_lines_that_say_the_same_of_what_is_asked_count_together(spark, monkeypatch):
    """Sets of measures over classes are those over lines; a matrix reads neither postings nor statistics of lines."""
    rng = random.Random(9)
    models = ["MODEL18A", "MODE118A", "MODELB8A", "OTHER77", "0THER77", "OTHER7Z"]
    rows = [(d, f"{d % 5:06}", f"BR {models[d % 3 if d % 4 else (d + rng.randrange(3)) % 6]} {rng.choice(['SMALL', 'SMALI', 'LARGE'])} {rng.randrange(4)}") for d in range(80)]
    lines = spark.createDataFrame(rows, "doc long, code string, descr string")
    index = build_index(lines.select("doc", F.concat_ws(" ", "code", "descr").alias("text")))
    fixed = correct.corrected_index(index)
    asked = evaluate.collection(lines), evaluate.collection(lines, "wildcard")
    want = []
    for name, ix, mode, (queries, qrels) in [("exact", index, NEVER, asked[0]), ("fuzzy if absent", index, FALLBACK, asked[0]), ("fuzzy always", index, ALWAYS, asked[0]), ("corrected", fixed, NEVER, asked[0]), ("corrected, fuzzy always", fixed, ALWAYS, asked[0]), ("wildcard", index, NEVER, asked[1]), ("wildcard, corrected", fixed, NEVER, asked[1])]:
        found = evaluate.set_measures(search.search(ix, queries, mode), queries, qrels, ix.corpus_stats)
        want += [tuple(r) for r in evaluate.averages(found, name).collect()]
    index.postings = index.doc_stats = index.corpus_stats = fixed.postings = fixed.terms = None
    monkeypatch.setattr(evaluate, "stable", lambda df, name="table", f=evaluate.stable: found.setdefault(name, []).append(f(df, name)) or found[name][-1])
    found = {}
    assert [tuple(r) for r in evaluate.set_matrix(index, fixed, lines).collect()] == want
    held = found["classes"][0].collect()
    assert sum(r.n for r in held) == 80 and len(held) < 60


def test_ranks_by_several_models_come_from_one_lookup(spark, monkeypatch):
    lines = spark.createDataFrame([(d, f"{d % 4:06}", f"BR MODEL{d % 4}{'X' if d % 5 else 'Y'} {'SMALL' if d % 3 else 'LARGE'} {d % 2}") for d in range(40)], "doc long, code string, descr string")
    index = build_index(lines.select("doc", F.concat_ws(" ", "code", "descr").alias("text")))
    queries, _ = evaluate.collection(lines)
    expansions, models = evaluate._expanded(index.terms, queries, NEVER), [search.NO_SCORE, search.BM25]
    wanted = {m: {(r.query_id, r.doc): r.rank for r in search.search_ranked(index, queries, m, True, expansions=expansions).collect()} for m in models}
    looked = []
    monkeypatch.setattr(search, "_met_words", lambda *a, f=search._met_words: looked.append(1) or f(*a))
    ranked = search.scores_of_all(index, queries, models, expansions).collect()
    assert len(looked) == 1 and all(wanted[m] and {(r.query_id, r.doc): r[m] for r in ranked} == wanted[m] for m in models)
