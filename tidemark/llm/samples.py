"""Bounded samples of labelled documents for the classifiers, and the rows they are scored over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> DataFrame:
    """doc_id, text, y of at most ``per_class`` documents of each label, by the order of a hash of their ids.

    Only rows that may be learnt from; null labels and ids are left out, and so are ids that have both labels. The ids chosen
    are at most 2 * per_class rows, which bounds what is broadcast. An id is one row however often it is in ``docs``:
    the one with the smallest hash of its text.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(learns(parts, held) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    one = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    classes = [one.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(classes[0].unionByName(classes[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), "y")


def contract(scored: DataFrame, parts: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted from doc_id, score."""
    return scored.select("doc_id", (~learns(parts, held)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
