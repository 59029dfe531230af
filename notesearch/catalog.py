"""All retrieval queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import escape_html, term_grams, tokens, url_parameters
from .operators import compress, correct, evaluate, expand, parse, search, similarity
from .operators.expand import ALWAYS, FALLBACK, NEVER
from .operators.index import Index, build_index, dictionary, settled
from .plans import corpora
from .session import shared_folder, stable
from .sources.notes import corpus_documents, read_corpus_tsv, with_line_ids, write_corpus
from .sources.persist import load_index, save_index


def _documents(spark, folder, *once: str) -> Index:
    """The index of documents; tables that a plan reads several times are named and computed once, postings first."""
    index = build_index(corpora.documents(spark, folder))
    return settled(index, *once) if once else index


def _line_rows(spark, folder) -> DataFrame:
    return stable(corpora.lines(spark, folder))


def _lines(spark, folder, rows: DataFrame | None = None, once: tuple[str, ...] = ()) -> Index:
    index = build_index((corpora.lines(spark, folder) if rows is None else rows).select("doc", F.concat_ws(" ", "code", "descr").alias("text")))
    return settled(index, *once) if once else index


def _counted_lines(spark, folder, rows: DataFrame) -> Index:
    """The index of lines of which only the dictionary is computed, without postings."""
    index = _lines(spark, folder, rows)
    index.terms = stable(dictionary(index.docs), "terms")
    return index


def _asked(spark, kind="documents") -> DataFrame:
    return corpora.query_table(spark, corpora.DOCUMENT_QUERIES if kind == "documents" else corpora.LINE_QUERIES)


def _dense(postings: DataFrame) -> DataFrame:
    """Postings with documents numbered densely from 0, as gaps need."""
    postings = stable(postings, "postings")
    ids = compress.numbered(postings.select("doc").distinct(), "doc", "id")
    return postings.join(ids, "doc").select("term", F.col("id").alias("doc"), "tf")


def _tokenize(spark, folder):
    return corpora.documents(spark, folder).select("doc", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def _sorted_dictionary(spark, folder):
    return _documents(spark, folder).terms.orderBy("term")


def _corpus_stats(spark, folder):
    return _documents(spark, folder).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _doc_stats(spark, folder):
    return _documents(spark, folder).doc_stats.select("doc", "len", F.round("norm", 6).alias("norm"))


def _membership(spark, folder):
    return _lines(spark, folder).contains(corpora.word_table(spark, corpora.WORDS))


def _search(kind, mode, every=True):
    def run(spark, folder):
        index = _documents(spark, folder, "terms") if kind == "documents" else _lines(spark, folder, once=("terms",))
        return (search.search if every else search.search_any)(index, _asked(spark, kind), mode)

    return run


def _ranked(kind, model, every, mode=NEVER):
    def run(spark, folder):
        once = ("terms",) if model == search.NO_SCORE else ("terms", "doc_stats")
        index = _documents(spark, folder, *once) if kind == "documents" else _lines(spark, folder, once=once)
        return search.search_ranked(index, _asked(spark, kind), model, every, mode)

    return run


def _top_k(spark, folder):
    return search.top_k(_documents(spark, folder, "terms", "doc_stats"), _asked(spark), 10, model=search.BM25, every=False, mode=NEVER)


def _search_tokens(spark, folder):
    return search.search_tokens(_documents(spark, folder, "terms"), _asked(spark))


def _kgrams(spark, folder):
    return _lines(spark, folder).terms.select("term", F.explode(term_grams(F.col("term"))).alias("gram"))


def _kgram_count(spark, folder):
    return expand.gram_index(_lines(spark, folder).terms).agg(F.count_distinct("gram").alias("n_grams"))


def _wildcard(spark, folder):
    return expand.wildcard(corpora.word_table(spark, corpora.PATTERNS), _lines(spark, folder).terms)


def _wildcard_search(spark, folder):
    return search.search(_documents(spark, folder, "terms"), corpora.query_table(spark, list(enumerate(corpora.DOCUMENT_PATTERNS))), NEVER)


def _levenshtein(spark, folder):
    words = corpora.word_table(spark, corpora.WORDS)
    return _lines(spark, folder).terms.select("term").crossJoin(F.broadcast(words)).select("word", "term", F.levenshtein("word", "term").alias("distance")).filter("distance <= 3")


def _fuzzy(spark, folder):
    near = expand.fuzzy(corpora.word_table(spark, corpora.WORDS), stable(_lines(spark, folder).terms))
    return near.withColumn("similarity", F.round("similarity", 6))


def _expand(mode):
    def run(spark, folder):
        return expand.expand(expand.words_of(_asked(spark, "lines")), stable(_lines(spark, folder).terms), mode)

    return run


def _corrections(spark, folder):
    return correct.corrections(stable(_lines(spark, folder).terms))


def _corrected_postings(spark, folder):
    return correct.corrected_index(_lines(spark, folder, _line_rows(spark, folder), ("terms",))).postings


def _corrected_search(spark, folder):
    return search.search_ranked(settled(correct.corrected_index(_lines(spark, folder, _line_rows(spark, folder), ("terms",))), "terms", "doc_stats"), _asked(spark, "lines"), search.BM25, True, FALLBACK)


def _correction_eval(spark, folder):
    rows = _line_rows(spark, folder)
    return correct.correction_eval(rows, stable(_lines(spark, folder, rows).terms))


def _note(function):
    return lambda spark, folder: function(stable(corpora.notes(spark, folder)))


def _headers(notes):
    return notes.select("doc_id", *parse.header(F.col("text")))


def _reason_counts(notes):
    return parse.rejects(notes).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _known_items(spark, folder):
    return evaluate.known_items(_line_rows(spark, folder))


def _set_matrix(spark, folder):
    rows = _line_rows(spark, folder)
    index = _counted_lines(spark, folder, rows)
    return evaluate.set_matrix(index, correct.corrected_index(index), rows)


def _rank_matrix(spark, folder):
    rows = _line_rows(spark, folder)
    return evaluate.rank_matrix(_lines(spark, folder, rows, ("terms", "doc_stats")), rows)


def _set_measures(spark, folder):
    rows = _line_rows(spark, folder)
    index = _lines(spark, folder, rows, ("terms", "doc_stats"))
    queries, qrels = evaluate.collection(rows)
    m = evaluate.set_measures(search.search(index, queries, NEVER), queries, qrels, index.corpus_stats)
    return m.select("query_id", "has_variants", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def _rank_measures(spark, folder):
    rows = _line_rows(spark, folder)
    index = _lines(spark, folder, rows, ("terms", "doc_stats"))
    queries, qrels = evaluate.collection(rows)
    m = evaluate.rank_measures(search.search_ranked(index, queries, search.BM25, True, NEVER), queries, qrels)
    return m.select("query_id", "has_variants", *(F.round(c, 6).alias(c) for c in ("ap", "p1", "r_precision")))


def _model_word_pairs(spark, folder):
    items = evaluate.known_items(_line_rows(spark, folder))
    return items.select(F.col("code").alias("pair_id"), F.split("exact", " ")[0].alias("a"), F.split("exact", " ")[1].alias("b"))


def _linear_cost(spark, folder):
    return search.intersections(_lines(spark, folder, once=("terms",)), stable(_model_word_pairs(spark, folder)))


def _skip_cost(spark, folder):
    return search.skip_costs(_lines(spark, folder), stable(_model_word_pairs(spark, folder)))


def _efficiency(skips):
    def run(spark, folder):
        rows = _line_rows(spark, folder)
        return evaluate.efficiency(_lines(spark, folder, rows, ("terms",)), rows, skips)

    return run


def _hashed_vectors(spark, folder):
    vectors = similarity.hashed_vectors(_lines(spark, folder).terms)
    return vectors.select("term", F.posexplode("vec").alias("slot", "value")).filter("value > 0").select("term", "slot", F.round("value", 6).alias("value"))


def _vector_system(spark, folder):
    rows = _line_rows(spark, folder)
    index = _counted_lines(spark, folder, rows)
    return evaluate.vector_system(index, rows, stable(similarity.hashed_vectors(index.terms), "vectors"))


def _corpus_roundtrip(spark, folder):
    """Notes parsed to a corpus, written as tab-separated text and read again as documents."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(with_line_ids(parse.articles(stable(corpora.notes(spark, folder)))), path, tsv=True)
    return corpus_documents(read_corpus_tsv(spark, path))


def _gaps(spark, folder):
    return compress.posting_gaps(_dense(_lines(spark, folder).postings))


def _gaps_roundtrip(spark, folder):
    return compress.gaps_decoded(compress.posting_gaps(_dense(_lines(spark, folder).postings)))


def _vbyte_sizes(spark, folder):
    return compress.vbyte_sizes(_dense(_lines(spark, folder).postings))


def _front_coding(spark, folder):
    return compress.front_coding(_lines(spark, folder).terms)


def _space_report(spark, folder):
    index = _lines(spark, folder, once=("terms",))
    return compress.space_report(_dense(index.postings), index.terms)


def _vbyte_roundtrip(spark, folder):
    return compress.unpacked(compress.packed(_dense(_lines(spark, folder).postings)))


def _dictionary_roundtrip(spark, folder):
    return compress.unpacked_dictionary(compress.packed_dictionary(_lines(spark, folder).terms))


def _dictionary_lookup(spark, folder):
    return compress.term_id(_lines(spark, folder).terms, corpora.word_table(spark, corpora.WORDS))


def _index_roundtrip(spark, folder):
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    save_index(_lines(spark, folder), path)
    return load_index(spark, path).postings


def _vectors(spark, folder):
    rows = corpora.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return similarity.normalised(rows)


def _vector_neighbours(spark, folder):
    vectors = _vectors(spark, folder)
    return similarity.neighbours(vectors.filter("vec_id % 100 = 0").select("vec_id"), vectors, "vec_id", 5, 0.3)


def _vector_search(spark, folder):
    """Search over neighbours; the term in place i of the dictionary of lines has vector i of embeddings."""
    index = _lines(spark, folder, once=("terms",))
    ids = compress.numbered(index.terms.select("term"), "term", "vec_id")
    vectors = stable(_vectors(spark, folder).join(ids, "vec_id").select("term", "vec"))
    return similarity.search_neighbours(index, corpora.query_table(spark, corpora.NEIGHBOUR_QUERIES), vectors, 0.2)


def _compressed_lookup(spark, folder):
    """Postings of a few terms, decoded from the packed index without the other terms."""
    packed = stable(compress.packed(_dense(_lines(spark, folder).postings)), "packed")
    return compress.lookup(packed, corpora.word_table(spark, corpora.WORDS))


def _html_escape(spark, folder):
    return corpora.table(spark, folder, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


def _url_params(spark, folder):
    pages = corpora.table(spark, folder, "pages").select("page_id", F.explode(url_parameters(F.regexp_extract("url", r"\?([^#]*)", 1))).alias("p"))
    return pages.select("page_id", "p.name", "p.value")


def _saved_queries():
    out = {
        "tokenize": _tokenize,
        "postings": lambda s, d: _documents(s, d).postings,
        "dictionary_df": _sorted_dictionary,
        "doc_stats": _doc_stats,
        "corpus_stats": _corpus_stats,
        "term_membership": _membership,
        "search_and": _search("documents", NEVER),
        "search_or": _search("documents", NEVER, False),
        "search_tokens": _search_tokens,
        "fuzzy_fallback": _search("lines", FALLBACK),
        "fuzzy_always": _search("lines", ALWAYS),
        "top_k": _top_k,
        "kgram_index": _kgrams,
        "kgram_count": _kgram_count,
        "wildcard_expand": _wildcard,
        "wildcard_search": _wildcard_search,
        "levenshtein_pairs": _levenshtein,
        "fuzzy_expand": _fuzzy,
        "expand_never": _expand(NEVER),
        "expand_fallback": _expand(FALLBACK),
        "expand_always": _expand(ALWAYS),
        "ocr_corrections": _corrections,
        "corrected_postings": _corrected_postings,
        "corrected_search": _corrected_search,
        "correction_eval": _correction_eval,
        "parse_header": _note(_headers),
        "parse_articles": _note(parse.articles),
        "parse_rejects": _note(parse.rejects),
        "reject_reasons": _note(_reason_counts),
        "build_counters": _note(parse.build_counters),
        "known_item_queries": _known_items,
        "eval_set_measures": _set_measures,
        "eval_rank_measures": _rank_measures,
        "eval_set_matrix": _set_matrix,
        "eval_rank_matrix": _rank_matrix,
        "intersect_linear_cost": _linear_cost,
        "intersect_skip_cost": _skip_cost,
        "efficiency_totals": _efficiency(True),
        "efficiency_linear": _efficiency(False),
        "hashed_vectors": _hashed_vectors,
        "eval_vector_system": _vector_system,
        "corpus_roundtrip": _corpus_roundtrip,
        "postings_gaps": _gaps,
        "gaps_roundtrip": _gaps_roundtrip,
        "vbyte_sizes": _vbyte_sizes,
        "dictionary_front_coding": _front_coding,
        "space_report": _space_report,
        "vbyte_roundtrip": _vbyte_roundtrip,
        "compressed_lookup": _compressed_lookup,
        "dictionary_roundtrip": _dictionary_roundtrip,
        "dictionary_lookup": _dictionary_lookup,
        "index_roundtrip": _index_roundtrip,
        "vector_neighbours": _vector_neighbours,
        "vector_search": _vector_search,
        "html_escape": _html_escape,
        "url_params": _url_params,
    }
    for model in (search.NO_SCORE, search.TFIDF, search.BM25):
        for every in (True, False):
            out[f"ranked_{model}_{'and' if every else 'or'}"] = _ranked("documents", model, every)
            out[f"ranked_{model}_{'and' if every else 'or'}_lines"] = _ranked("lines", model, every, FALLBACK)
    return out


@functools.cache
def queries():
    return _saved_queries()


def oracle_sql():
    from .oracles import oracle_sql as found

    return found()
