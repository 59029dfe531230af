"""Documents that arrive over time: postings grow batch by batch.

Adding a document touches its own postings only, so each micro-batch is counted on its own and
appended; document frequencies and statistics are views over what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, build_index, index_of


def add_documents(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of streamed documents (doc, text) under path.

    Each batch overwrites its own folder, so a batch that is run again after a failure changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        index = build_index(batch)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_index(spark: SparkSession, path: str) -> Index:
    """The index over all batches so far."""
    docs = spark.read.parquet(f"{path}/docs").select("doc", "text")
    postings = spark.read.parquet(f"{path}/postings").select("term", "doc", "tf")
    return index_of(docs, postings)
