"""Which terms a query word stands for: itself, a pattern's matches, or similar spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_pattern, longest_edit, query_words, term_grams

#: Fuzzy modes: never, for words that are no terms, always.
NEVER, FALLBACK, ALWAYS = "never", "fallback", "always"
#: The least share of common grams.
SIMILARITY = 0.2
#: Longest word whose forms with fewer characters are keys.
LONGEST_CUT = 12


def words_of(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) as distinct (query_id, word)."""
    return queries.select("query_id", F.explode(query_words(F.col("text"))).alias("word")).distinct()


def gram_index(terms: DataFrame) -> DataFrame:
    """gram, term, n_grams: a row for each distinct gram of a term with marked ends."""
    each = terms.select("term", term_grams(F.col("term")).alias("grams"))
    return each.select(F.explode("grams").alias("gram"), "term", F.size("grams").alias("n_grams"))


def wildcard(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term: terms that match a pattern, where * is any run.

    Patterns meet terms by what stands before their first star or after their last, whichever is longer; only
    patterns without either are compared with the whole dictionary.
    """
    head, tail = F.substring_index("word", "*", 1), F.substring_index("word", "*", -1)
    asked = words.select("word", like_pattern(F.col("word")).alias("pattern"), head.alias("head"), tail.alias("tail")).distinct()
    by_head = F.length("head") >= F.length("tail")
    known = terms.select("term")
    found = known.join(asked.filter("head = '' AND tail = ''").select("word", "pattern"), F.expr("term LIKE pattern")).select("word", "term")
    for key, chosen, part in (("head", by_head, lambda n: F.substring(F.col("term"), F.lit(1), n)), ("tail", ~by_head, lambda n: F.substring(F.col("term"), -n, n))):
        mine = asked.filter(chosen & (F.col(key) != "")).select("word", "pattern", F.col(key).alias("key"))
        sizes = mine.agg(F.collect_set(F.length("key")).alias("sizes"))  # one row, of numbers up to the longest pattern
        keys = F.transform(F.filter("sizes", lambda n: n <= F.length("term")), part)
        keyed = known.crossJoin(F.broadcast(sizes)).select("term", F.explode(keys).alias("key"))
        found = found.unionByName(keyed.join(mine, "key").filter("term LIKE pattern").select("word", "term"))
    return found


def _cut(word: Column) -> Column:
    """The words with one character less."""
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, each).otherwise(F.array().cast("array<string>"))


def _cuts(word: Column) -> Column:
    """The word and all words with one or two characters less."""
    size = F.length(word)
    less = lambda i: F.transform(F.sequence(i + 1, size), lambda j: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, size)))
    twice = F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(1), size - 1), less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), _cut(word), twice))


def _piece(text: Column, size: Column, k: int, shift: int = 0) -> Column:
    """Third k of a word of some size, at that place of a text, or a few characters further."""
    start, end = F.floor(size * k / 3), F.floor(size * (k + 1) / 3)
    return F.concat_ws(" ", size, F.lit(k), F.substring(text, (start + shift + 1).cast("int"), (end - start).cast("int")))


def _candidates(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """asked (word, edits) with term: every term that may be so few edits away, some twice.

    Words at most two edits apart become equal by leaving out at most two characters of each.  Long words would
    have many such forms; two edits leave one third of a long word as it is, moved by at most two characters.
    """
    size = F.length("term")
    lengths = asked.agg(F.collect_set(F.length("word")).alias("lengths"))  # one row, of numbers up to the longest word
    near = F.exists("lengths", lambda n: F.abs(n - size) <= 2)
    known = terms.select("term").crossJoin(F.broadcast(lengths)).filter(near).select("term")
    short = asked.filter(F.length("word") <= LONGEST_CUT).withColumn("key", F.explode(_cuts(F.col("word"))))
    cut = known.filter(size <= LONGEST_CUT + 2).select("term", F.explode(_cuts(F.col("term"))).alias("key"))
    long = asked.filter(F.length("word") > LONGEST_CUT).withColumn("key", F.explode(F.array(*(_piece(F.col("word"), F.length("word"), k) for k in range(3)))))
    sized = known.filter(size > LONGEST_CUT - 2).select("term", F.explode(F.sequence(size - 2, size + 2)).alias("size")).filter(F.col("size") > LONGEST_CUT)
    places = F.array(*(_piece(F.col("term"), F.col("size"), k, shift) for k in range(3) for shift in range(-2, 3) if k or shift >= 0))
    pieces = sized.select("term", F.explode(F.array_distinct(places)).alias("key"))
    return short.join(cut, "key").unionByName(long.join(pieces, "key")).select("word", "edits", "term")


def fuzzy(words: DataFrame, terms: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """word, term, similarity, distance: terms that share enough grams and are few edits away.

    Edits are looked up first, by keys that few terms share; grams of many words meet in long lists.
    """
    asked = words.select("word").distinct().withColumn("edits", longest_edit(F.col("word")))
    close = F.abs(F.length("word") - F.length("term")) <= F.col("edits")
    near = _candidates(asked, terms).filter(close).withColumn("distance", F.levenshtein("word", "term")).filter("distance <= edits").distinct()
    grams = near.withColumns({"of_word": term_grams(F.col("word")), "of_term": term_grams(F.col("term"))})
    grams = grams.withColumn("common", F.size(F.array_intersect("of_word", "of_term"))).filter("common > 0")
    similarity = F.col("common") / (F.size("of_word") + F.size("of_term") - F.col("common"))
    return grams.withColumn("similarity", similarity).filter(F.col("similarity") >= least).select("word", "term", "similarity", "distance")


def expand(words: DataFrame, terms: DataFrame, mode: str = FALLBACK) -> DataFrame:
    """query_id, word, term.  Patterns expand in every mode; a word that stands for nothing has no row."""
    plain, patterns = words.filter(~F.col("word").contains("*")), words.filter(F.col("word").contains("*"))
    known = plain.join(terms.select(F.col("term").alias("word")), "word", "left_semi").select("query_id", "word", F.col("word").alias("term"))
    out = patterns.join(wildcard(patterns, terms), "word").select("query_id", "word", "term")
    if mode == ALWAYS:
        return out.unionByName(plain.join(fuzzy(plain, terms), "word").select("query_id", "word", "term"))
    out = out.unionByName(known)
    if mode == FALLBACK:
        absent = plain.join(terms.select(F.col("term").alias("word")), "word", "left_anti")
        out = out.unionByName(absent.join(fuzzy(absent, terms), "word").select("query_id", "word", "term"))
    return out
