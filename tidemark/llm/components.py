"""Connected components of an edge table, by Spark joins; nothing but a count of changes comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node of ``edges`` (a, b long). Isolated nodes don't occur.

    Each round takes the smallest label around a node and then follows that label once (so paths halve, and rounds are few
    however long a chain is); every round is written to the shared folder. A node with very many edges is summed before it is shuffled.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "cc-edges")
    labels = written(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = labels.join(near, "node").join(up, "label")
        moved = written(new.select("node", F.col("label").alias("old"), F.least("label", "near", "up").alias("label")), "cc-labels")
        done = not moved.where("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if done:
            return labels
