"""Text files of scanned notes, and tab-separated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stable

CORPUS_COLUMNS = ["line_id", "doc_id", "number", "date", "code", "descr"]
REJECT_COLUMNS = ["doc_id", "reason", "text"]


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text: every *.txt of a folder (not of its subfolders), named without the ending."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def with_line_ids(articles: DataFrame) -> DataFrame:
    """Numbers lines from 1 over (doc_id, pos), and over what they say where notes share a doc_id.  Notes are dealt to ranges; the counts of ranges give offsets, so no task sees all."""
    sizes = stable(articles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "notes")
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_part"))
    in_part = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("of_part") + F.coalesce(F.sum("n").over(in_part), F.lit(0))
    notes = sizes.join(F.broadcast(offsets), "part").select("doc_id", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "number", "date", "code", "descr"))
    return articles.join(notes, "doc_id").withColumn("line_id", (F.col("before") + inside).cast("long")).select(CORPUS_COLUMNS)


def _write_tsv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Unescaped text; every file begins with a header line."""
    lines = rows.select(*(F.col(c).cast("string") for c in columns))
    lines.write.mode("overwrite").options(sep="\t", header="true", quote="", escapeQuotes="false", emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_corpus(corpus: DataFrame, path: str, tsv: bool = False) -> None:
    """Parquet in the order of line_id, or unescaped tab-separated text with a header."""
    ordered = corpus.select(CORPUS_COLUMNS).repartitionByRange("line_id").sortWithinPartitions("line_id")
    _write_tsv(ordered, CORPUS_COLUMNS, path) if tsv else ordered.write.mode("overwrite").parquet(path)


def write_rejects(rejects: DataFrame, path: str, tsv: bool = False) -> None:
    _write_tsv(rejects, REJECT_COLUMNS, path) if tsv else rejects.select(REJECT_COLUMNS).write.mode("overwrite").parquet(path)


def read_corpus_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """line_id, doc_id, number, date, code, descr; the last column keeps any further tabs."""
    rows = spark.read.text(path)
    if header:
        rows = rows.filter(~F.col("value").startswith("riga_id\t") & ~F.col("value").startswith("line_id\t"))
    parts = F.split("value", "\t", 6)
    return rows.select(parts[0].cast("long").alias("line_id"), *(parts[k].alias(c) for k, c in enumerate(CORPUS_COLUMNS) if k))


def corpus_documents(corpus: DataFrame) -> DataFrame:
    """doc, text: documents to index; doc counts from 0."""
    return corpus.select((F.col("line_id") - 1).alias("doc"), F.concat_ws(" ", "code", "descr").alias("text"))
