"""Connected components of a graph held as two columns of vertex numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_groups, release, write_table


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): label is the least node of the component; nodes without links are absent.

    links has long columns a and b, repeats and either order allowed.  labels may hold an earlier
    result over part of the links.  Each round takes the least label among neighbours, then follows
    it once more, so the distance covered doubles; rounds end when no label changes.  Every round
    writes its labels to the shared folder.  A vertex with very many links is joined by broadcast:
    join_groups bounds how many there can be.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).filter("node <> to").distinct()
    edges = write_table(both, "edges")
    n_edges = edges.count()
    degrees = edges.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.least(F.col("node"), F.min("to")).alias("label"))
    if labels is not None:
        earlier = labels.select("node", F.col("label").alias("__label"))
        degrees = degrees.join(earlier, "node", "left").withColumn("label", F.least("label", "__label")).drop("__label")
    now = write_table(degrees, "labels")
    while True:
        around = join_groups(edges.select(F.col("to").alias("node"), F.col("node").alias("for")), now, ["node"], "degree", n_edges)
        best = around.groupBy("for").agg(F.min("label").alias("__near"))
        near = now.join(best.withColumnRenamed("for", "node"), "node", "left").withColumn("near", F.least("label", "__near"))
        sizes = near.groupBy("near").agg(F.count(F.lit(1)).alias("__n"))
        ahead = write_table(sizes.join(now.select(F.col("node").alias("near"), F.col("label").alias("__ahead")), "near"), "jumps")
        jumped = join_groups(near, ahead, ["near"], "__n", n_edges).select("node", "degree", F.least("near", "__ahead").alias("label"), (F.least("near", "__ahead") < F.col("label")).alias("changed"))
        then = write_table(jumped, "labels")
        changed = then.filter("changed").limit(1).count()
        release(now, ahead)
        now = then.drop("changed")
        now._shared_path = then._shared_path  # so that release() finds it
        if not changed:
            release(edges)
            return now.select("node", "label")
