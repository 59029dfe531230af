"""Saving and loading an index as a folder of Parquet tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correct import corrected_index
from ..operators.index import Index, build_index
from .notes import corpus_documents, read_corpus_tsv

FORMAT, VERSION = "notesearch-index", 1
#: Delta encodings: sorted terms and documents then take the least space and row groups are pruned by term.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
TABLES = ("docs", "postings", "terms", "doc_stats", "corpus_stats")


class NotAnIndex(OSError):
    """The folder is not an index of this format and version."""


def save_index(index: Index, path: str) -> None:
    order = {"docs": ["doc"], "postings": ["term", "doc"], "terms": ["term"], "doc_stats": ["doc"]}
    for name in TABLES:
        table = getattr(index, name)
        if name in order:
            table = table.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
        table.write.mode("overwrite").options(**DELTA).parquet(f"{path}/{name}")
    spark = index.docs.sparkSession
    spark.createDataFrame([(FORMAT, VERSION)], "format string, version int").write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> Index:
    """Raises NotAnIndex for any other folder, format or version."""
    try:
        meta = spark.read.parquet(f"{path}/meta").collect()
    except Exception as error:
        raise NotAnIndex(f"{path} holds no index; save one with save_index") from error
    if [tuple(r) for r in meta] != [(FORMAT, VERSION)]:
        raise NotAnIndex(f"{path} has another format or version: {meta}")
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def open_index(spark: SparkSession, corpus: str | None = None, saved: str | None = None, corrected: bool = False) -> Index:
    """A saved index, or one built from a tab-separated corpus; optionally with corrected terms."""
    if saved:
        return load_index(spark, f"{saved}/{'corrected' if corrected else 'base'}")
    if corpus is None:
        raise ValueError("name a corpus or a saved index")
    base = build_index(corpus_documents(read_corpus_tsv(spark, corpus)))
    return corrected_index(base) if corrected else base


def same(a: DataFrame, b: DataFrame) -> bool:
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def save_both(index: Index, path: str) -> dict[str, bool]:
    """Saves the index and its corrected form, loads them again and compares terms and postings."""
    spark, out = index.docs.sparkSession, {}
    for name, ix in (("base", index), ("corrected", corrected_index(index))):
        save_index(ix, f"{path}/{name}")
        again = load_index(spark, f"{path}/{name}")
        out[name] = same(ix.terms, again.terms) and same(ix.postings, again.postings)
    return out


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def save_report(index: Index, path: str, corpus: str | None = None) -> list[str]:
    """save_both as lines of text: bytes of the corpus, if named, and of both indexes, and whether they load as they were saved."""
    spark, equal = index.docs.sparkSession, save_both(index, path)
    sizes = [*([("corpus", corpus)] if corpus else []), *((name, f"{path}/{name}") for name in equal)]
    return [f"{name}: {stored_bytes(spark, where)} bytes" for name, where in sizes] + [f"{name} reloaded equals saved: {same_rows}" for name, same_rows in equal.items()]


def startup_seconds(ready: Callable[[], Index], times: int = 3) -> dict[str, float]:
    """first, median and least seconds until an index answers a term count."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        ready().terms.agg(F.count(F.lit(1))).collect()
        took.append(time.perf_counter() - began)
    return {"first": took[0], "median": sorted(took)[len(took) // 2], "least": min(took)}
