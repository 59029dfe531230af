"""Worked examples on one index: how postings, grams, expansion, ranking and correction come about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.codecs import gaps, skip_comparisons, vbyte_bytes
from .functions.text import term_grams
from .operators.correct import corrections
from .operators.expand import fuzzy, gram_index, wildcard
from .operators.index import Index
from .operators.search import BM25, TFIDF, search_ranked
from .plans.corpora import query_table, word_table


def posting_list(index: Index, term: str, first: int = 12) -> dict:
    """The first documents of a term, and their bytes as gaps."""
    docs = [r.doc for r in index.postings_of(term).orderBy("doc").limit(first).collect()]
    coded = vbyte_bytes(gaps(docs))
    return {"term": term, "docs": docs, "gaps": gaps(docs), "raw_bytes": 4 * len(docs), "coded": coded.hex(" ").upper(), "coded_bytes": len(coded)}


def intersection(index: Index, a: str, b: str) -> dict:
    """Two lists, and what meeting them costs with and without skips."""
    lists = [[r.doc for r in index.postings_of(t).orderBy("doc").collect()] for t in (a, b)]
    common = sorted(set(lists[0]) & set(lists[1]))
    linear = 0
    if lists[0] and lists[1]:
        end = min(lists[0][-1], lists[1][-1])
        linear = sum(d <= end for x in lists for d in x) - len(common)
    return {"df": [len(x) for x in lists], "common": common, "linear": linear, "with_skips": skip_comparisons(*lists)}


def gram_table(index: Index, word: str) -> DataFrame:
    """gram, terms: in how many terms each gram of a word occurs."""
    asked = word_table(index.docs.sparkSession, [word]).select(F.explode(term_grams(F.col("word"))).alias("gram"))
    return asked.join(gram_index(index.terms), "gram", "left").groupBy("gram").agg(F.count("term").alias("terms"))


def expansions(index: Index, word: str) -> DataFrame:
    """What a pattern matches, or which spellings are near, with similarity and distance."""
    words = word_table(index.docs.sparkSession, [word])
    return wildcard(words, index.terms) if "*" in word else fuzzy(words, index.terms)


def rankings(index: Index, query: str, first: int = 5) -> DataFrame:
    """The first results of one query under both weightings: model, rank, doc, score."""
    asked = query_table(index.docs.sparkSession, [(1, query)])
    both = [search_ranked(index, asked, m, every=False, limit=first).select(F.lit(m).alias("model"), "rank", "doc", "score") for m in (TFIDF, BM25)]
    return both[0].unionByName(both[1])


def corrected_terms(index: Index, first: int = 25) -> DataFrame:
    return corrections(index.terms).orderBy("term").limit(first)


def outcome(results: DataFrame, qrels: DataFrame, query_id) -> dict:
    """Right, wrong and missed documents of one query."""
    got = {r.doc for r in results.filter(F.col("query_id") == query_id).collect()}
    wanted = {r.doc for r in qrels.filter(F.col("query_id") == query_id).collect()}
    return {"tp": sorted(got & wanted), "fp": sorted(got - wanted), "fn": sorted(wanted - got)}
