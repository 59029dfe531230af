"""Stand-ins for delivery notes, and fixed query sets.  The texts are synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (query_id, text) asked of `documents` and of `lines`.
DOCUMENT_QUERIES = [(1, "the thing"), (2, "and of that"), (3, "der die und"), (4, "th*ing the"), (5, "zzz*"), (6, "é* le"), (7, "the THE the"), (8, "")]
LINE_QUERIES = [(1, "small widget"), (2, "smal widgit"), (3, "hot gear"), (4, "w*t gizm"), (5, "larg* anvil old"), (6, "rinq"), (7, "0000* blue"), (8, "cold cold rod")]
NEIGHBOUR_QUERIES = [(1, "000001"), (2, "000002 000003"), (3, "000010 small"), (4, "000007"), (5, "000004 000004"), (6, "")]
DOCUMENT_PATTERNS = ["*ing", "th*n", "un*", "*hea*", "a*b* of", "*%*", "é*", "zz*zz"]
WORDS = ["small", "smal", "widgit", "anvill", "rinq", "gear", "plat", "gizmos", "bl", "old", "000123", "00012", "c4ca4238a0", "c4ca4238ao"]
PATTERNS = ["smal*", "*dget", "w*t", "*in*", "00*7", "zz*", "*"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc, code, descr: one article line for each order line; every eleventh has its model misread."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("int").alias("qty"))
    name = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.upper("p_name").alias("name"))
    model = F.substring(F.md5(F.col("part").cast("string").cast("binary")), 1, 10)
    misread = (7 * F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0
    model = F.upper(F.when(misread, F.translate(model, "8", "b")).otherwise(model))
    joined = rows.join(name, "part")
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.lpad(F.col("part").cast("string"), 6, "0").alias("code"), F.concat(F.lit("BR "), model, F.lit(" "), "name", F.lit(" "), F.col("qty").cast("string")).alias("descr"))


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("doc", F.concat_ws(" ", "code", "descr").alias("text"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text: pages of noisy text, one for each order, with article lines among others."""
    rows = lines(spark, folder).withColumn("order", F.floor(F.col("doc") / 10).cast("long"))
    noisy = F.concat(F.when(F.col("doc") % 3 == 0, F.lit("|. | ")).otherwise(F.lit("")), "code", F.when(F.col("doc") % 5 == 0, F.lit(" - ")).otherwise(F.lit(" ")), F.lit("BRON"), F.expr("substring(descr, 3)"), F.when(F.col("doc") % 4 == 0, F.lit(" i _.")).otherwise(F.lit("")))
    line = F.when(F.col("order") % 13 == 0, F.lit("RIGA ILLEGGIBILE")).otherwise(noisy)
    pages = rows.groupBy("order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    number = F.lpad(F.col("order").cast("string"), 6, "0")
    head = F.when(F.col("order") % 7 == 0, F.lit("PAGINA SENZA NUMERO")).otherwise(F.concat(F.lit("DESTINATAR "), number, F.lit(". Pg 1/1 03/02/2026 Vendita")))
    text = F.concat(head, F.lit("\n001519 - 078 LUOGO DI DESTINAZION\n  20025 LEGNANO CORSO RICCI, 211R\n\nRif. citato in fatt. VEND 006893\n"), "body", F.lit("\f17100 SAVONA SV\nfirma"))
    return pages.select(number.alias("doc_id"), text.alias("text"))


def query_table(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(queries, "query_id int, text string").coalesce(1)


def word_table(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
