"""Tokens, character grams, patterns, escaping: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and decimal digits; characters beyond U+FFFF separate, whatever they are."""
    return F.filter(F.split(F.lower(text), r"[^[\p{L}\p{Nd}]&&[\x{0}-\x{FFFF}]]+"), lambda t: t != "")


def query_words(text: Column) -> Column:
    """Words of a query: lower-cased and split at white space only, so patterns keep their stars."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def grams(word: Column, k: int = GRAM) -> Column:
    """Sliding k-grams in order; none if the word is shorter."""
    return F.when(F.length(word) >= k, F.transform(F.sequence(F.lit(1), F.length(word) - (k - 1)), lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def term_grams(term: Column, k: int = GRAM) -> Column:
    """Distinct k-grams of a term with its ends marked."""
    return F.array_distinct(grams(F.concat(F.lit("$"), term, F.lit("$")), k))


def like_pattern(word: Column) -> Column:
    """A word with stars as a LIKE pattern: everything else is literal."""
    literal = F.regexp_replace(word, r"([\\%_])", r"\\$1")
    return F.replace(literal, F.lit("*"), F.lit("%"))


def longest_edit(word: Column) -> Column:
    """Edits allowed for a query word: one up to four characters, else two."""
    return F.when(F.length(word) <= 4, 1).otherwise(2)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ between words of equal length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


#: Characters that optical recognition confuses, as pairs.
CONFUSED = ("0o", "1i", "5s", "6g", "8b", "7t")


def folded(term: Column) -> Column:
    """The same for terms that differ only in confusable characters."""
    return F.translate(term, "".join(p[0] for p in CONFUSED), "".join(p[1] for p in CONFUSED))


def escape_html(text: Column) -> Column:
    """Markup characters as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def url_parameters(query: Column) -> Column:
    """array<struct<name, value>> of a query string, decoded; items without a name are left out, and a part with a broken escape is null."""
    items = F.filter(F.split(query, "&"), lambda i: ~i.rlike("^=") & i.contains("="))
    return F.transform(items, lambda i: F.struct(F.try_url_decode(F.substring_index(i, "=", 1)).alias("name"), F.try_url_decode(F.regexp_extract(i, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def vbyte_size(number: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    size = F.lit(1)
    for k in range(1, 9):
        size = F.when(number >= (1 << (7 * k)), k + 1).otherwise(size)
    return size
