"""The inverted index as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stable


@dataclass
class Index:
    """docs(doc, text), postings(term, doc, tf), terms(term, df), doc_stats(doc, len, norm), corpus_stats(n, avgdl); fixes(term, fixed) if terms were corrected."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    fixes: DataFrame | None = None

    def cache(self) -> "Index":
        for name in ("postings", "terms", "doc_stats"):
            getattr(self, name).cache()
        return self

    def contains(self, words: DataFrame) -> DataFrame:
        """The rows of words (word) that are terms."""
        return words.join(self.terms.select(F.col("term").alias("word")), "word", "left_semi")

    def postings_of(self, *terms: str) -> DataFrame:
        return self.postings.filter(F.col("term").isin(*terms))


def build_index(docs: DataFrame, corrections: DataFrame | None = None) -> Index:
    """docs has doc (any unique key) and text; corrections (term, fixed) rewrite terms once, not texts."""
    words = docs.select("doc", F.explode(tokens(F.col("text"))).alias("term"))
    counted = words.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    if corrections is not None:  # after counting, so that each (term, doc) is looked up once
        fixed = counted.join(corrections.select("term", "fixed"), "term", "left")
        counted = fixed.groupBy(F.coalesce("fixed", "term").alias("term"), "doc").agg(F.sum("tf").alias("tf"))
    index = index_of(docs, counted)
    index.fixes = corrections
    return index


def dictionary(docs: DataFrame) -> DataFrame:
    """term, df of docs (doc, text) without postings: doc is a unique key, so a document is one row."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_of(docs: DataFrame, postings: DataFrame) -> Index:
    """Dictionary and statistics of given postings (term, doc, tf)."""
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = 1 + F.ln("tf")
    stats = postings.groupBy("doc").agg(F.sum("tf").alias("len"), F.sqrt(F.sum(weight * weight)).alias("norm"))
    stats = docs.select("doc").join(stats, "doc", "left").select("doc", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    return Index(docs.select("doc", "text"), postings, terms, stats, _corpus_stats(stats))


def _corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def settled(index: Index, *names: str) -> Index:
    """The index with some of its tables computed once, in the shared folder, for plans that read them several times.

    Without names that is the postings, from which terms and statistics follow by one aggregation each.
    """
    once = index_of(index.docs, stable(index.postings, "postings"))
    once.fixes = index.fixes
    for name in names:
        setattr(once, name, stable(getattr(once, name), name))
    if "doc_stats" in names:
        once.corpus_stats = _corpus_stats(once.doc_stats)
    return once
