"""Terms near each other in a vector space, and search over such neighbours.

Subword embeddings are not part of Spark: vectors may be supplied, trained with Word2Vec, or hashed
from character grams.  The last two are stand-ins and rank differently from a subword model.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import grams, tokens
from ..session import importable, stable
from .index import Index
from .search import search

#: Nearest terms considered, and the least cosine among them.
NEAREST, LEAST_COSINE = 5, 0.9
#: Bytes of a block of asked vectors, and rows of the dictionary that meet it at a time.
BLOCK_BYTES, ROWS = 4 << 20, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """Vectors at length one; null vectors stay zero."""
    length = F.sqrt(dot(F.col(vector), F.col(vector)))
    return vectors.withColumn(vector, F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)))


def hashed_vectors(terms: DataFrame, size: int = 64) -> DataFrame:
    """term, vec: counts of hashed character grams of three to six characters, normalised."""
    marked = F.concat(F.lit("<"), F.col("term"), F.lit(">"))
    every = F.flatten(F.array(*(grams(marked, k) for k in range(3, 7))))
    slot = lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")  # noqa: E731  (MD5, so that SQL has the same slots)
    slots = terms.select("term", F.explode(F.transform(every, slot)).alias("slot")).groupBy("term", "slot").count()
    maps = slots.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("slot", "count"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double"))
    return normalised(maps.select("term", vec.alias("vec")))


def trained_vectors(docs: DataFrame, size: int = 50, seed: int = 1) -> DataFrame:
    """term, vec: Word2Vec on the tokens of docs (text), normalised."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="t", outputCol="v").fit(docs.select(tokens(F.col("text")).alias("t")))
    return normalised(model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec")))


def neighbours(asked: DataFrame, vectors: DataFrame, key: str = "term", nearest: int = NEAREST, least: float = LEAST_COSINE) -> DataFrame:
    """asked key, neighbour, cosine: the nearest few, of which those close enough; the key itself included.

    vectors are normalised and of one length; asked has the keys.  Asked vectors are cut into blocks of at most
    BLOCK_BYTES; each task takes the blocks one at a time, multiplies them with its batches of the dictionary and keeps the
    nearest few of each asked key, so what is shuffled is a few rows for each key and task.
    """
    mine = stable(vectors.join(asked.select(key).distinct(), key, "left_semi").select(F.col(key).alias("asked"), "vec"), "asked")
    kind = mine.schema["asked"].dataType.simpleString()
    found = None
    for block in _blocks_of(mine):
        near = _nearest_in_parts(vectors.select(F.col(key).alias("neighbour"), "vec"), block, kind, nearest, least)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"asked {kind}, neighbour {kind}, cosine double")
    w = Window.partitionBy("asked").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= nearest).select("asked", "neighbour", "cosine")


def _blocks_of(mine: DataFrame):
    """Yields (keys, matrix) of asked vectors, of at most BLOCK_BYTES each."""
    keys, rows, size = [], [], 0
    for row in mine.toLocalIterator():
        keys.append(row["asked"])
        rows.append(np.array(row["vec"], np.float64))
        size += rows[-1].nbytes
        if size >= BLOCK_BYTES:
            yield keys, np.array(rows)
            keys, rows, size = [], [], 0
    if keys:
        yield keys, np.array(rows)


def _nearest_in_parts(vectors: DataFrame, block: tuple, kind: str, nearest: int, least: float) -> DataFrame:
    """asked, neighbour, cosine: for each asked key of a block the nearest few of each partition, if close enough."""
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def run(frames):
        keys, matrix = sent.value
        best: list[list] = [[] for _ in keys]
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                part = frame.iloc[start : start + ROWS]
                names = part["neighbour"].tolist()
                cosines = matrix @ np.stack(part["vec"].tolist()).astype(np.float64).T
                rows, columns = np.nonzero(cosines >= least - 1e-6)  # few are rounded
                rounded = np.round(cosines[rows, columns], 6)
                for row, column, cosine in zip(rows.tolist(), columns.tolist(), rounded.tolist()):
                    if cosine >= least:
                        best[row].append((-cosine, names[column]))
                    if len(best[row]) > 8 * nearest:
                        best[row] = heapq.nsmallest(nearest, best[row])
        rows = [(key, name, -negative) for key, few in zip(keys, best) for negative, name in heapq.nsmallest(nearest, few)]
        yield pd.DataFrame(rows, columns=["asked", "neighbour", "cosine"])

    return importable(vectors).mapInPandas(run, f"asked {kind}, neighbour {kind}, cosine double")


def near_words(queries: DataFrame, vectors: DataFrame, least: float = LEAST_COSINE) -> tuple[DataFrame, DataFrame]:
    """query_id, word of all tokens of queries, and word, term of the neighbours of each."""
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("word")).distinct()
    near = neighbours(words.select(F.col("word").alias("term")), vectors, least=least).select(F.col("asked").alias("word"), F.col("neighbour").alias("term"))
    return words, stable(near, "near")


def search_neighbours(index: Index, queries: DataFrame, vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """query_id, doc: every token of the query met by one of its neighbours."""
    words, near = near_words(queries, vectors, least)
    return search(index, queries, words=words, expansions=near)
