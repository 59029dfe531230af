"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next one.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notesearch.llm import bpe, exact_dedup, language, mixing, near_dedup
from notesearch.llm.queries import tokenizer_path
from notesearch.llm.shared import write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told.  Likelihoods are fitted on labelled rows of its input."""
    return language.accepted_documents(docs, language.fit_text_model(docs))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: one row for each time the mix reads a document."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: SQL expresses neither the language model nor byte-pair encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name)
    return docs
