import random
import threading
import urllib.request
import os

import pytest
from pyspark.sql import functions as F

from notesearch import cli, examples, web
from notesearch.operators import evaluate, parse, search
from notesearch.operators.correct import corrected_index
from notesearch.operators.expand import ALWAYS, FALLBACK, NEVER
from notesearch.operators.index import build_index
from notesearch.plans.corpora import query_table
from notesearch.sources import notes, persist
from notesearch.streaming.incremental import add_documents, grown_index

WORDS = "lavatrice 7kg tv smart nero friggitrice aria perché frigo bianco slim lavastoviglie 8gb 166b".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(d, f"cod{d} " + " ".join(rng.choice(WORDS) for _ in range(5))) for d in range(300)], "doc long, text string")


@pytest.fixture(scope="module")
def saved(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    assert persist.save_both(build_index(corpus), path) == {"base": True, "corrected": True}
    return path


def test_loaded_index_answers_alike(spark, corpus, saved):
    index, loaded = build_index(corpus).cache(), persist.load_index(spark, f"{saved}/base")
    assert persist.same(index.doc_stats.select("doc", "len"), loaded.doc_stats.select("doc", "len"))
    asked = query_table(spark, list(enumerate(["lavatrice 7kg", "lava*", "*frig*", "friggitrici", "perché smart", "assente", "tv smart nero"])))
    for mode in (NEVER, FALLBACK, ALWAYS):
        assert persist.same(search.search(index, asked, mode), search.search(loaded, asked, mode))
    for model in (search.NO_SCORE, search.TFIDF, search.BM25):
        for every in (True, False):
            assert persist.same(search.search_ranked(index, asked, model, every), search.search_ranked(loaded, asked, model, every))


def test_foreign_folders_are_refused(spark, tmp_path, saved):
    with pytest.raises(persist.NotAnIndex):
        persist.load_index(spark, str(tmp_path / "none"))
    spark.createDataFrame([("other", 9)], "format string, version int").write.parquet(str(tmp_path / "x" / "meta"))
    with pytest.raises(persist.NotAnIndex):
        persist.load_index(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        persist.open_index(spark)
    assert persist.open_index(spark, saved=saved, corrected=True).terms.count() > 0
    assert set(persist.startup_seconds(lambda: persist.load_index(spark, f"{saved}/base"), 2)) == {"first", "median", "least"}


def test_notes_to_corpus_and_back(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "b.txt").write_text("006220 Pg 1/1 03/02/2026\n937518 ABC MODEL one\n937519 ABC OTHER\ttab\n")
    (folder / "a.txt").write_text("nothing")
    (folder / "c.md").write_text("937518 ABC MODEL")
    pages = notes.read_notes(spark, str(folder))
    assert sorted(r.doc_id for r in pages.collect()) == ["a", "b"]
    lines = notes.with_line_ids(parse.articles(pages))
    assert [(r.line_id, r.code) for r in lines.orderBy("line_id").collect()] == [(1, "937518"), (2, "937519")]
    notes.write_corpus(lines, str(tmp_path / "c"), tsv=True)
    notes.write_rejects(parse.rejects(pages), str(tmp_path / "r"), tsv=True)
    again = notes.read_corpus_tsv(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lines.collect()))
    assert [tuple(r) for r in notes.corpus_documents(again).orderBy("doc").collect()] == [(0, "937518 ABC MODEL one"), (1, "937519 ABC OTHER tab")]
    (tmp_path / "h.tsv").write_text("riga_id\tdoc_id\tnumero\tdata\tcodice\tdescrizione\n1\td\t\t\t9\tx\ty\n")
    assert notes.read_corpus_tsv(spark, str(tmp_path / "h.tsv")).first().descr == "x\ty"


def test_command_line(spark, saved, capsys):
    assert cli.main(["lavatrice 7kg", "--file", saved, "--bm25", "--or"])[0].endswith("results")
    assert len(cli.main(["tv", "--file", saved, "--ocr", "--no-fuzzy"])) == 11
    assert cli.main(["qqqqq", "--file", saved, "--tfidf"]) == ["0 results"]
    with pytest.raises(SystemExit):
        cli.main([])


def test_page(spark):
    index = build_index(spark.createDataFrame([(0, "100 ARIE friggitrice <b>aria</b>"), (1, "101 SEKO frigo 2P")], "doc long, text string"))
    pages = web.Pages(spark, index, corrected_index(index))
    got = pages.page({"q": "fri*"})
    assert "2 results" in got and "&lt;b&gt;aria&lt;/b&gt;" in got and "<b>" not in got
    assert "<section>" not in pages.page({"q": "  "}) and "<section>" not in pages.page({})
    assert '"><script>' not in pages.page({"q": '"><script>'})
    assert "1 results" in pages.page({"q": "friggitrice aria", "or": "1"})
    assert "2 results" in pages.page({"q": "friggitrice frigo", "or": "1"}) and "0 results" in pages.page({"q": "friggitrice frigo"})
    chosen = pages.page({"q": "frigo", "fuzzy": "always", "order": "bm25", "ocr": "1"})
    assert 'value="always" selected' in chosen and 'value="bm25" selected' in chosen and "checked" in chosen
    assert f'value="{FALLBACK}" selected' in pages.page({"q": "", "fuzzy": "nonsense"})
    server = web.serve(pages, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/?q=fri%2A") as answer:
        assert "2 results" in answer.read().decode()
    server.shutdown()


def test_parameters():
    assert web.parameters("q=lava%2A&ocr=1") == {"q": "lava*", "ocr": "1"}
    assert web.parameters(None) == {} and web.parameters("=x&y&z=a=b") == {"z": "a=b"}


def test_examples(spark, corpus):
    index = build_index(corpus).cache()
    some = examples.posting_list(index, "aria")
    assert len(some["docs"]) == 12 and some["coded_bytes"] < some["raw_bytes"]
    meet = examples.intersection(index, "aria", "tv")
    assert meet["linear"] >= meet["with_skips"] > 0 and meet["common"]
    assert examples.gram_table(index, "tv").count() == 2 and examples.expansions(index, "lava*").count() == 2
    assert examples.expansions(index, "friggitrici").first().distance == 1
    assert examples.rankings(index, "tv smart").count() == 10 and examples.corrected_terms(index).count() >= 0
    results, qrels = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, doc int"), spark.createDataFrame([(1, 2), (1, 3)], "query_id int, doc int")
    assert examples.outcome(results, qrels, 1) == {"tp": [2], "fp": [1], "fn": [3]}


def test_documents_that_arrive_later(spark, corpus, tmp_path):
    source, path = tmp_path / "in", tmp_path / "index"
    for part in (corpus.filter("doc < 100"), corpus.filter("doc >= 100")):
        part.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(corpus.schema).parquet(str(source))
        add_documents(stream, str(path), str(tmp_path / "progress")).awaitTermination()
    grown, whole = grown_index(spark, str(path)), build_index(corpus)
    assert persist.same(grown.postings, whole.postings) and persist.same(grown.terms, whole.terms)
    assert persist.same(grown.doc_stats.select("doc", "len", F.round("norm", 9)), whole.doc_stats.select("doc", "len", F.round("norm", 9)))
    assert grown.corpus_stats.first() == whole.corpus_stats.first()


def test_save_report_names_bytes_and_equality(spark, corpus, tmp_path):
    source = tmp_path / "corpus.tsv"
    source.write_text("x" * 123)
    told = persist.save_report(build_index(corpus), str(tmp_path / "both"), str(source))
    assert told[0] == "corpus: 123 bytes" and told[3:] == ["base reloaded equals saved: True", "corrected reloaded equals saved: True"]
    assert all(int(line.split()[1]) > 1000 for line in told[1:3])


def test_report_of_evaluation(spark):
    sets = spark.createDataFrame([("exact", "all", 3, 1.0, 0.5, 2 / 3, 0.9996), ("exact", "variants", 0, None, None, None, None)], "system string, subset string, n long, precision double, recall double, f1 double, accuracy double").coalesce(1)
    ranks = spark.createDataFrame([("and bm25", "all", 3, 0.8456, 1.0, 0.25)], "system string, subset string, n long, ap double, p1 double, r_precision double")
    work = spark.createDataFrame([("query terms", 3, 20, 12)], "workload string, n_queries long, linear long, skip long")
    told = evaluate.report(sets, ranks, work)
    assert [line.split() for line in told if line] == [
        ["system", "set", "P", "R", "F1", "acc"],
        ["exact", "all", "1.000", "0.500", "0.667", "0.9996", "(n=3)"],
        ["variants", "0.000", "0.000", "0.000", "0.0000", "(n=0)"],
        ["system", "set", "MAP", "P@1", "R-prec"],
        ["and", "bm25", "all", "0.846", "1.000", "0.250", "(n=3)"],
        ["comparisons", "of", "document", "numbers", "(intersection", "of", "two", "terms)"],
        ["query", "terms", "3", "queries:", "linear", "20,", "with", "skips", "12"],
    ]


def test_line_ids_do_not_depend_on_the_order_of_rows(spark):
    rows = [("000001", pos, "000001", "03/02/2026", f"{k:06}", f"BRON {k}") for pos in range(3) for k in range(40)]
    numbered = lambda each: sorted(tuple(r) for r in notes.with_line_ids(spark.createDataFrame(each, "doc_id string, pos int, number string, date string, code string, descr string")).collect())
    assert numbered(rows) == numbered(rows[::-1]) == [(k + 1, *row[:1], *row[2:]) for k, row in enumerate(rows)]
