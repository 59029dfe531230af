"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of four sources of evidence:

* the text: likelihoods of word-bounded character trigrams, fitted on a sample of labelled documents;
* the language that the markup declares, right with a probability fitted on the records whose text has at
  least CLEAR_WORDS words: how often the declaration names the likeliest language of the text;
* the suffix of the address and the host: a prior smoothed from host to suffix to all records, each level
  counted by a grouped aggregation over every record.  A record votes for the language it declares, else
  for the likeliest by its text; its own vote is taken out of every count before it is judged, so that no
  evidence counts twice.

A record is rejected when its text has no word of letters, so that nothing speaks for a language, when
the best language's posterior is under ACCEPT, or when the text resembles no fitted language: its mean
log-likelihood a trigram is under the bound of every language.  A bound is fitted on labelled texts: halfway
between what they reach when left out of the counts and what their letters reach in random order, and
lower for short texts, of which little can be told.

Defined results.  Null texts and pages are empty: their language follows from the other evidence, and
they are rejected.  A null or unreadable address or declaration is no evidence.  Equal posteriors fall
to the language first in order.  Equal rows get equal results.  Other columns play no part; an empty
table gives an empty result.  Without labelled documents the text is no evidence.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Memo
from .shared import broadcast_if_small, give_back, join_groups, null_safe_key, own_names, ready_workers, text_digest, write_table

#: Labelled documents that the likelihoods are fitted on: of each language, and of all languages together (one of each language at least).
SAMPLE_ROWS = 300
SAMPLE_ALL = 30_000
#: Labelled documents with more characters than this are fitted on only where shorter ones do not suffice.
SAMPLE_CHARS = 20_000
#: Records that a level's counts are worth against the level below: host to suffix, suffix to all.
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 50.0
#: Words of a text that is clear about its language, and what is believed of declarations at first: how often they are right, for how many records.
CLEAR_WORDS = 20
DECLARED_RIGHT, DECLARED_STRENGTH = 0.9, 20.0
#: Words beyond this many add no further certainty.
TEXT_WEIGHT_WORDS = 200.0
ACCEPT = 0.5
#: A text may fall this many standard deviations, at its number of trigrams, under the bound of a language.
BOUND_DEVIATIONS = 2.0
#: Letters drawn to tell how noise scores.
NOISE_LETTERS = 5_000
#: Words whose likelihoods a worker remembers, in each of two generations.
MEMO_WORDS = 50_000

_word = re.compile(r"[^\W\d_]+")
_drop = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_tag = re.compile(r"<[^>]*>")


def visible_text(page: str | None) -> str:
    """The text of a web page without scripts, styles, comments and tags."""
    return html.unescape(_tag.sub(" ", _drop.sub(" ", page or "")))


class TextModel:
    """Trigram likelihoods by language; evidence() is the mean gain of a word over the best language."""

    def __init__(self, counts_of: dict[str, Counter], texts_of: dict[str, list[Counter]] | None = None):
        self.languages = sorted(counts_of)
        tables = []
        for language in self.languages:
            counts = counts_of[language]
            tables.append((dict(counts), sum(counts.values())))
        known = {t for best, _ in tables for t in best}
        size = len(known) + 1
        self.table = {t: np.array([math.log((best.get(t, 0) + 0.5) / (total + 0.5 * size)) for best, total in tables]) for t in known}
        self.unknown = np.array([math.log(0.5 / (total + 0.5 * size)) for _, total in tables])
        self._tables = [(best, total, size) for best, total in tables]
        self.bound, self.spread = np.array([self._bound(k, (texts_of or {}).get(language, [])) for k, language in enumerate(self.languages)]).T
        del self._tables

    def _bound(self, k: int, texts: list[Counter]) -> tuple[float, float]:
        """The mean log-likelihood a trigram that parts texts of language k from letter noise, and the variance of one trigram.

        It is halfway between the median of the labelled texts, each left out of the counts, and the
        mean of letters drawn independently as often as the language has them.
        """
        best, total, size = self._tables[k]
        means, spreads, letters = [], [], Counter()
        for text in texts:
            n = sum(text.values())
            for t, c in text.items():
                letters[t[1]] += c
            if not n or n == total:
                continue
            rest = total - n + 0.5 * size
            values = np.array([math.log((max(0, best.get(t, 0) - c) + 0.5) / rest) for t, c in text.items()])
            weights = np.array(list(text.values())) / n
            means.append(float(values @ weights))
            spreads.append(float((values - means[-1]) ** 2 @ weights))
        if not means:
            return -math.inf, 0.0
        drawn = random.Random(0).choices(sorted(letters), [letters[x] for x in sorted(letters)], k=NOISE_LETTERS)
        noise = np.mean([self.table.get("".join(drawn[j : j + 3]), self.unknown)[k] for j in range(len(drawn) - 2)])
        return (float(np.median(means)) + float(noise)) / 2, float(np.median(spreads))

    def resembles(self, total: np.ndarray, n: int) -> bool:
        """Whether a text of n trigrams with these log-likelihoods is within the bound of some language."""
        return not n or bool((total / n >= self.bound - BOUND_DEVIATIONS * np.sqrt(self.spread / n)).any())

    @staticmethod
    def trigrams(text: str) -> Counter:
        return Counter(t for word in _word.findall(text.lower()) for p in (f" {word} ",) for t in (p[k : k + 3] for k in range(len(p) - 2)))

    def word(self, word: str) -> np.ndarray:
        padded = f" {word} "
        total = np.zeros(len(self.languages))
        for k in range(len(padded) - 2):
            total = total + self.table.get(padded[k : k + 3], self.unknown)
        return total

    def evidence(self, text: str, memo) -> tuple[np.ndarray, int, bool]:
        """Log-likelihoods of the text (all words; tempered beyond TEXT_WEIGHT_WORDS), its number of words and whether it resembles a language."""
        words = _word.findall(text.lower())
        total, known = np.zeros(len(self.languages)), True
        if words:
            seen: dict[str, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            total = np.array([memo[w] for w in seen]).T @ np.array(list(seen.values()), np.float64)
            known = self.resembles(total, sum(map(len, words)))
            total = total * min(1.0, TEXT_WEIGHT_WORDS / len(words))
        return total, len(words), known


def fit_text_model(docs: DataFrame, language_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> TextModel:
    """Fits on at most SAMPLE_ROWS labelled documents, one for each id, of every language, SAMPLE_ALL in all."""
    labelled = docs.filter(F.col(language_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(language_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = write_table(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")), "languages")
    each = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // max(1, sizes.count())))
    least = Window.partitionBy("lang").orderBy("long", "hash", F.col("id").asc_nulls_last())
    place = F.xxhash64("id").cast("double") / 2.0**64 + 0.5  # the least hashes: some more than wanted, however many rows a language has
    few = labelled.join(broadcast_if_small(sizes), "lang").filter(place <= (4 * each + 50) / F.col("of_lang"))
    keys = few.groupBy("lang", "id").agg((F.min(F.length("text")) > SAMPLE_CHARS).alias("long")).withColumn("hash", F.xxhash64("id"))
    chosen = keys.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= each).select(F.col("lang").alias("chosen_lang"), F.col("id").alias("chosen"))
    texts = labelled.join(F.broadcast(chosen), (F.col("lang") == F.col("chosen_lang")) & F.col("id").eqNullSafe(F.col("chosen")), "left_semi")
    counts_of: dict[str, Counter] = {}
    texts_of: dict[str, list[Counter]] = {}
    for row in texts.groupBy("lang", "id").agg(F.min(F.struct(F.length("text"), "text"))["text"].alias("text")).orderBy("lang", "id").toLocalIterator():
        trigrams = TextModel.trigrams(row["text"])
        counts_of.setdefault(row["lang"], Counter()).update(trigrams)
        texts_of.setdefault(row["lang"], []).append(trigrams)
    return TextModel(counts_of or {"und": Counter()}, texts_of)


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+)$", 1)


def declared_language(page: Column) -> Column:
    """The primary language of the html tag, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))


def text_evidence(records: DataFrame, model: TextModel, carry: list[str], is_page: bool) -> DataFrame:
    """carry columns, n_words, loglik array<double> and known (resembles a fitted language); records has the column text."""
    ready_workers(records.sparkSession)
    sent = records.sparkSession.sparkContext.broadcast(model)
    rows = records.select(*carry, "text")
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches):
        memo = Memo(sent.value.word, MEMO_WORDS)
        for batch in batches:
            n, likelihoods, resembling = [], [], []
            for text in batch.column(len(carry)).to_pylist():
                total, words, known = sent.value.evidence(visible_text(text) if is_page else (text or ""), memo)
                n.append(words)
                likelihoods.append(total.tolist())
                resembling.append(known)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(n, pa.int64()), pa.array(likelihoods, pa.list_(pa.float64())), pa.array(resembling, pa.bool_())], names=[*carry, "n_words", "loglik", "known"])
        memo.forget()
        give_back()

    return rows.mapInArrow(run, ", ".join([*fields, "n_words long", "loglik array<double>", "known boolean"]))


def fuse(evidence: DataFrame, languages: list[str], carry: list[str]) -> DataFrame:
    """carry columns, lang, posterior, n_words, declared, host, accepted.

    evidence, a written table, has carry, n_words, loglik, declared, suffix, host and may have known.
    """
    n = len(languages)
    best = F.array_max("loglik")
    by_text = F.element_at(F.array(*map(F.lit, languages)), F.array_position("loglik", best).cast("int"))
    said = F.col("declared").isin(languages)
    vote = F.when(said, F.col("declared")).when(F.col("n_words") > 0, by_text)
    place = F.md5(F.concat_ws("\n", "suffix", "host"))  # keys of fixed width
    rows = evidence.withColumns({"vote": vote, "place": place, "area": F.md5("suffix")})
    clear = said & (F.col("n_words") >= CLEAR_WORDS)
    ones = [F.count_if(F.col("vote") == lang).alias(f"c{k}") for k, lang in enumerate(languages)]
    hosts = write_table(rows.groupBy("area", "place").agg(F.count(F.lit(1)).alias("host_rows"), F.count_if(clear).alias("clear"), F.count_if(clear & (F.col("declared") == by_text)).alias("right"), *ones), "hosts")
    again = [F.sum(f"c{k}").alias(f"s{k}") for k in range(n)]
    suffixes = write_table(hosts.groupBy("area").agg(F.count(F.lit(1)).alias("suffix_hosts"), F.sum("host_rows").alias("suffix_rows"), F.sum("clear").alias("clear"), F.sum("right").alias("right"), *again), "suffixes")
    whole = suffixes.agg(F.sum("suffix_rows").alias("rows"), F.sum("clear").alias("clear"), F.sum("right").alias("right"), *(F.sum(f"s{k}").alias(f"g{k}") for k in range(n))).first()
    everywhere = [whole[f"g{k}"] or 0 for k in range(n)]
    declared_right = ((whole["right"] or 0) + DECLARED_STRENGTH * DECLARED_RIGHT) / ((whole["clear"] or 0) + DECLARED_STRENGTH)
    slim = suffixes.select("area", "suffix_hosts", F.array(*(f"s{k}" for k in range(n))).alias("of_suffix"))
    levels = join_groups(hosts, slim, ["area"], "suffix_hosts", hosts.count()).select("place", "host_rows", F.array(*(f"c{k}" for k in range(n))).alias("of_host"), "of_suffix")
    full = join_groups(rows, write_table(levels, "levels"), ["place"], "host_rows", int(whole["rows"] or 0))
    own = [(F.col("vote").eqNullSafe(F.lit(lang))).cast("double") for lang in languages]
    voted = F.col("vote").isNotNull().cast("double")
    overall = [(everywhere[k] - own[k] + 1) / (sum(everywhere) - voted + n) for k in range(n)]
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - voted
    full = full.withColumns({"__all": F.array(*overall), "__n_suffix": total("of_suffix"), "__n_host": total("of_host")})
    of_suffix = [(F.col("of_suffix")[k] - own[k] + SUFFIX_STRENGTH * F.col("__all")[k]) / (F.col("__n_suffix") + SUFFIX_STRENGTH) for k in range(n)]
    full = full.withColumn("__suffix", F.array(*of_suffix))
    of_host = [(F.col("of_host")[k] - own[k] + HOST_STRENGTH * F.col("__suffix")[k]) / (F.col("__n_host") + HOST_STRENGTH) for k in range(n)]
    prior = F.when(F.col("host") != "", F.array(*of_host)).otherwise(F.col("__all"))
    right, wrong = math.log(declared_right), math.log((1 - declared_right) / max(1, n - 1))
    of_markup = [F.when(said, F.when(F.col("declared") == lang, right).otherwise(wrong)).otherwise(0.0) for lang in languages]
    full = full.withColumn("__prior", prior)
    scores = F.array(*(F.col("loglik")[k] + F.ln(F.col("__prior")[k]) + of_markup[k] for k in range(n)))
    out = full.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
    weight = F.aggregate(F.transform("scores", lambda s: F.exp(s - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    at = F.array_position("scores", F.col("top")).cast("int")
    known = F.col("known") if "known" in evidence.columns else F.lit(True)
    accepted = (F.col("n_words") > 0) & known & (1.0 / weight >= ACCEPT)
    return out.select(*carry, F.element_at(F.array(*map(F.lit, languages)), at).alias("lang"), (1.0 / weight).alias("posterior"), "n_words", "declared", "host", accepted.alias("accepted"))


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, lang, posterior, n_words, declared, host, accepted."""
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), suffix_of(host).alias("suffix"), declared_language(F.col(html_col)).alias("declared"), F.col(html_col).alias("text"))
    evidence = write_table(text_evidence(rows, model, ["page_id", "host", "suffix", "declared"], True), "evidence")
    return fuse(evidence, model.languages, ["page_id"])


def _judged_documents(docs: DataFrame, model: TextModel, id_col: str, text_col: str, source_col: str, carry: dict[str, Column]) -> DataFrame:
    columns = {"doc_id": F.col(id_col), "host": null_safe_key(F.col(source_col)), "suffix": F.lit(""), "declared": F.lit(""), **carry, "text": F.col(text_col)}
    rows = docs.select(*(c.alias(name) for name, c in columns.items()))
    evidence = write_table(text_evidence(rows, model, rows.columns[:-1], False), "evidence")
    return fuse(evidence, model.languages, ["doc_id", *carry]).drop("declared")


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, lang, posterior, n_words, host, accepted; its source stands for the host."""
    return _judged_documents(docs, model, id_col, text_col, source_col, {})


def accepted_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs without those that identification rejects, columns unchanged.  A row is judged by its id, source and text together."""
    verdicts = _judged_documents(docs, model, id_col, text_col, source_col, {"digest": text_digest(F.col(text_col))})
    drop, source, text = own_names(docs.columns, "drop", "source", "text")
    rejected = verdicts.filter(~F.col("accepted")).select(F.col("doc_id").alias(drop), F.col("host").alias(source), F.col("digest").alias(text)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(drop)) & (null_safe_key(F.col(source_col)) == F.col(source)) & (text_digest(F.col(text_col)) == F.col(text))
    return docs.join(broadcast_if_small(write_table(rejected, "rejected")), same, "left_anti").select(docs.columns)
