"""Search from the command line: python -m notesearch.cli QUERY [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators.expand import FALLBACK, NEVER
from .operators.search import BM25, NO_SCORE, TFIDF, search_ranked
from .plans.corpora import query_table
from .session import session
from .sources.persist import open_index

SHOWN = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notesearch", description=__doc__)
    p.add_argument("query")
    p.add_argument("--corpus", help="tab-separated corpus to index")
    p.add_argument("--file", help="folder of a saved index (with base and corrected)")
    p.add_argument("--no-fuzzy", action="store_true", help="do not look for similar spellings of absent words")
    p.add_argument("--ocr", action="store_true", help="search the index with corrected terms")
    p.add_argument("--tfidf", action="store_true")
    p.add_argument("--bm25", action="store_true", help="wins over --tfidf")
    p.add_argument("--or", dest="any", action="store_true", help="any word instead of all")
    return p


def main(arguments: list[str] | None = None) -> list[str]:
    """Prints and returns the number of results and the first texts."""
    a = parser().parse_args(arguments)
    spark = session()
    index = open_index(spark, a.corpus, a.file, a.ocr)
    model = BM25 if a.bm25 else TFIDF if a.tfidf else NO_SCORE
    found = search_ranked(index, query_table(spark, [(1, a.query)]), model, not a.any, NEVER if a.no_fuzzy else FALLBACK).cache()
    first = found.filter(F.col("rank") <= SHOWN).join(index.docs, "doc").orderBy("rank").select("text").collect()
    out = [f"{found.count()} results", *(row["text"] for row in first)]
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
