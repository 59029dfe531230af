"""How far postings and dictionary compress, and the packed forms themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codecs import pack_gaps, pack_numbers, pack_terms, unpack_gaps, unpack_numbers, unpack_terms
from ..functions.text import vbyte_size
from ..session import importable, stable

#: Terms of a front-coded block.
BLOCK = 8
#: Document numbers of a stretch of a posting list.
RANGE = 1 << 16


def numbered(rows: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Dense numbers from 0 in the order of a column, without one task that sees all rows.

    Rows are range-partitioned once and kept with their partition's number in the checkpoint folder; a
    small table of partition sizes gives each partition its offset.
    """
    dealt = stable(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + inside - 1).cast("long")).drop("__part", "__before")


def _ranges(postings: DataFrame) -> DataFrame:
    """Adds range: the stretch of RANGE document numbers, so that a frequent term is many pieces of work."""
    return postings.withColumn("range", F.floor(F.col("doc") / RANGE).cast("long"))


def _with_gaps(postings: DataFrame) -> DataFrame:
    """postings with gap: the distance to the document before in the same list.

    Within a range by the order of its documents; the first of a range is measured from the last document of the ranges before.
    """
    rows = _ranges(postings)
    last = rows.groupBy("term", "range").agg(F.max("doc").alias("last"))
    start = F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("range")), F.lit(0))
    inside = F.lag("doc").over(Window.partitionBy("term", "range").orderBy("doc"))
    joined = rows.join(last.select("term", "range", start.alias("start")), ["term", "range"])
    return joined.withColumn("gap", F.col("doc") - F.coalesce(inside, F.col("start"))).drop("range", "start")


def posting_gaps(postings: DataFrame) -> DataFrame:
    """term, doc, gap: the distance to the document before in the same list."""
    return _with_gaps(postings).select("term", "doc", "gap")


def gaps_decoded(gaps: DataFrame) -> DataFrame:
    """term, doc from term, doc (for the order only) and gap."""
    rows = _ranges(gaps)
    sums = rows.groupBy("term", "range").agg(F.sum("gap").alias("sum"))
    start = F.coalesce(F.sum("sum").over(Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("gap").over(Window.partitionBy("term", "range").orderBy("doc").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums.select("term", "range", start.alias("start")), ["term", "range"]).select("term", (F.col("start") + inside).alias("doc"))


def vbyte_sizes(postings: DataFrame) -> DataFrame:
    """term, raw_bytes, gap_bytes, tf_bytes."""
    return _with_gaps(postings).groupBy("term").agg((4 * F.count(F.lit(1))).alias("raw_bytes"), F.sum(vbyte_size(F.col("gap"))).cast("long").alias("gap_bytes"), F.sum(vbyte_size(F.col("tf"))).cast("long").alias("tf_bytes"))


def _in_blocks(terms: DataFrame) -> DataFrame:
    ranked = numbered(terms.select("term"), "term")
    return ranked.withColumns({"block": F.floor(F.col("number") / BLOCK).cast("long"), "place": (F.col("number") % BLOCK).cast("int")})


def front_coding(terms: DataFrame) -> DataFrame:
    """term, block, place, shared, coded_bytes: bytes shared with the term before in the block, and bytes stored."""
    w = Window.partitionBy("block").orderBy("place")
    rows = _in_blocks(terms).withColumn("before", F.lag("term").over(w))
    a, b = F.hex(F.col("term").cast("binary")), F.hex(F.col("before").cast("binary"))
    least = F.least(F.octet_length("term"), F.octet_length("before"))
    places = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, i * 2 - 1, F.lit(2)) != F.substring(b, i * 2 - 1, F.lit(2)))
    first_other = F.array_position(places, True)
    shared = F.when(F.col("before").isNull(), 0).when(first_other > 0, first_other - 1).otherwise(least).cast("int")
    rows = rows.withColumn("shared", shared)
    rest = F.octet_length("term") - F.col("shared")
    coded = F.when(F.col("place") > 0, vbyte_size(F.col("shared"))).otherwise(0) + vbyte_size(rest) + rest
    return rows.select("term", "block", "place", "shared", coded.cast("long").alias("coded_bytes"))


def space_report(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: raw and compressed bytes of dictionary, postings and term frequencies, and distinct pairs."""
    words = front_coding(terms).agg(F.sum(1 + F.octet_length("term")).alias("dictionary_raw"), (F.sum("coded_bytes") + 4 * F.count_if(F.col("place") == 0)).alias("dictionary_coded"))
    lists = vbyte_sizes(postings).agg(F.sum("raw_bytes").alias("postings_raw"), F.sum("gap_bytes").alias("postings_coded"), F.sum("tf_bytes").alias("tf_coded"))
    return words.crossJoin(lists)


def packed(postings: DataFrame) -> DataFrame:
    """term, range, docs (binary: gaps in variable bytes, from the start of the range), tfs (binary): the compressed index.

    Documents must be non-negative numbers.  A list of any length is cut by ranges of documents, so no cell holds more than RANGE of them.
    """
    rows = _ranges(postings).withColumn("doc", F.col("doc") - F.col("range") * RANGE)
    lists = importable(rows).groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("doc", "tf"))).alias("p"))
    return lists.select("term", "range", pack_gaps(F.col("p.doc")).alias("docs"), pack_numbers(F.col("p.tf")).alias("tfs"))


def unpacked(lists: DataFrame) -> DataFrame:
    """term, doc, tf from packed lists."""
    both = importable(lists).select("term", "range", unpack_gaps("docs").alias("doc"), unpack_numbers("tfs").alias("tf"))
    return both.select("term", "range", F.explode(F.arrays_zip("doc", "tf")).alias("p")).select("term", (F.col("range") * RANGE + F.col("p.doc")).alias("doc"), "p.tf")


def lookup(lists: DataFrame, words: DataFrame) -> DataFrame:
    """term, doc, tf of the asked words (word): only their lists are decoded."""
    return unpacked(lists.join(words.select(F.col("word").alias("term")).distinct(), "term", "left_semi"))


def packed_dictionary(terms: DataFrame) -> DataFrame:
    """block, data: front-coded blocks of the sorted dictionary."""
    blocks = _in_blocks(terms).groupBy("block").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return importable(blocks).select("block", pack_terms(F.col("terms")).alias("data"))


def unpacked_dictionary(blocks: DataFrame) -> DataFrame:
    """term from front-coded blocks."""
    return importable(blocks).select(F.explode(unpack_terms("data")).alias("term"))


def term_id(terms: DataFrame, words: DataFrame) -> DataFrame:
    """word, id: place of each word in the sorted dictionary, -1 if absent."""
    ids = numbered(terms.select("term"), "term", "id")
    return words.select("word").join(ids.withColumnRenamed("term", "word"), "word", "left").fillna(-1, ["id"])
