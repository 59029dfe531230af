"""Correction of terms that optical recognition misread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded, hamming, tokens
from .index import Index, build_index

#: Shortest term that is corrected, and the most characters that may be swapped.
SHORTEST, MOST_SWAPS = 4, 2


def corrections(terms: DataFrame) -> DataFrame:
    """term, fixed, df, fixed_df: a more frequent term that differs by one or two confusable characters.

    Such terms have the same folded form, so one equality join finds all of them.  The most frequent
    wins, then the first in the alphabet.
    """
    key = terms.select("term", "df", folded(F.col("term")).alias("fold"))
    wrong = key.filter((F.length("term") >= SHORTEST) & ~F.col("term").rlike(r"^\p{Nd}+$"))
    right = key.select(F.col("term").alias("fixed"), F.col("df").alias("fixed_df"), "fold")
    swaps = hamming(F.col("term"), F.col("fixed"))
    pairs = wrong.join(right, "fold").filter((F.col("fixed_df") > F.col("df")) & (F.length("term") == F.length("fixed"))).filter(swaps.between(1, MOST_SWAPS))
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("fixed_df"), "fixed"))
    return pairs.withColumn("place", best).filter("place = 1").select("term", "fixed", "df", "fixed_df")


def corrected_index(index: Index, fixes: DataFrame | None = None) -> Index:
    """The index with misread terms replaced; texts and query words stay as they are."""
    return build_index(index.docs, corrections(index.terms) if fixes is None else fixes)


def reference_readings(lines: DataFrame) -> DataFrame:
    """code, descr: the most frequent reading of each code with several lines; ties go to the greater text."""
    counted = lines.groupBy("code", "descr").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("code").orderBy(F.desc("n"), F.desc("descr"))
    total = F.sum("n").over(Window.partitionBy("code"))
    return counted.withColumns({"place": F.row_number().over(w), "lines": total}).filter("place = 1 AND lines >= 2").select("code", "descr")


def known_errors(lines: DataFrame) -> DataFrame:
    """term, truth: tokens that differ from the reference reading of their code at the same place.

    One truth for each term: the one with most support, then the first in the alphabet.
    """
    reference = reference_readings(lines).select("code", tokens(F.col("descr")).alias("right"))
    read = lines.groupBy("code", "descr").agg(F.count(F.lit(1)).alias("support")).select("code", "support", tokens(F.col("descr")).alias("wrong"))
    both = read.join(reference, "code").filter(F.size("wrong") == F.size("right"))
    each = both.select("support", F.explode(F.arrays_zip("wrong", "right")).alias("t")).select("support", F.col("t.wrong").alias("term"), F.col("t.right").alias("truth"))
    letters = lambda c: F.col(c).rlike("[a-z]")
    only = lambda c: F.col(c).rlike("^[a-z]+$")
    comparable = (F.col("term") != F.col("truth")) & (F.length("term") == F.length("truth")) & (F.length("truth") > 3)
    valid = each.filter(comparable & letters("term") & letters("truth") & (only("term") == only("truth")))
    summed = valid.groupBy("term", "truth").agg(F.sum("support").alias("support"))
    w = Window.partitionBy("term").orderBy(F.desc("support"), "truth")
    return summed.withColumn("place", F.row_number().over(w)).filter("place = 1").select("term", "truth")


def correction_eval(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: proposed, right, wrong, unverifiable corrections; known errors and those recovered."""
    both = corrections(terms).select("term", "fixed").join(known_errors(lines), "term", "full")
    proposed, known = F.col("fixed").isNotNull(), F.col("truth").isNotNull()
    right = proposed & known & (F.col("fixed") == F.col("truth"))
    return both.agg(
        F.count_if(proposed).alias("proposed"),
        F.count_if(right).alias("right"),
        F.count_if(proposed & known & (F.col("fixed") != F.col("truth"))).alias("wrong"),
        F.count_if(proposed & ~known).alias("unverifiable"),
        F.count_if(known).alias("known"),
        F.count_if(right).alias("recovered"),
    )
