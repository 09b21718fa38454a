"""Mixing sources to target weights: every source gives its budget of words, whole epochs first, the rest by a cut.

Documents get a hash-random key; within a source they are range-sorted by it (a bucket is a range of keys) and a
prefix sum of their sizes runs over that order: sums of buckets first, then inside each bucket, so that no task ever
holds a source. A source's budget is ``floor(target)`` words: as many whole epochs as fit, then the documents before
the cut, and of the document on the cut the words that are left. Built-in functions only.

Targets: sources in code point order, null last, weigh 3, 1, 2 in turn and share ``share`` times all words; a target
stops at ``most`` times its source's words, and what is left over is shared by weight among the others.
Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is keyed as such. Documents of size
0 take 0. Repeated rows are rows of their own. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Hexadecimal digits of a key that make its bucket: 4096 ranges of keys in each source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target; ``sizes`` has a row per source: source, source_size.

    With sources in order of most * size / weight, those before some place are capped, the others get weight * level;
    the level of each place comes from running sums, and the right one is the first that caps no further source.
    The windows run over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    levels = w.select(
        "*",
        F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(everything).alias("all"),
    ).withColumn("level", (share * F.col("all") - most * F.col("capped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    final = levels.withColumn("at_level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    cap = (most * F.col("source_size")).cast("double")
    return final.select("source", "source_size", F.least(cap, F.coalesce(F.col("at_level") * F.col("weight"), cap)).alias("target"))


def key_of(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str, more: dict[str, Column]) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs (whole ones), left (words after them) and prefix (words of the source before the row); and ``more``.

    Rows of a source are in order of key, doc_id, ``more``, size.
    """
    sized = written(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key_of(seed).alias("key"), *(c.alias(n) for n, c in more.items())).withColumn("range", F.substring("key", 1, RANGE_DIGITS)),
        "mix-sized",
    )
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    goal = targets(sums.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, share, most)
    # At most 16 ** RANGE_DIGITS rows of each source here, whatever its number of documents.
    before = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    g, b = goal.alias("g"), before.alias("b")
    ranges = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select(F.col("b.source").alias("s"), F.col("range").alias("r"), F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target")
    rows = sized.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", *more, "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "key", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("left"), prefix.alias("prefix"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("prefix")))
    return placed(docs, weights, share, most, seed, {}).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = SEED) -> DataFrame:
    """The mix as rows of ``docs``: each as often as the mix takes it.

    Documents stay whole, so a source may pass its budget by less than one document. Rows of size 0 stay as they are.
    Texts are not shuffled: a source's rows are taken up to one row, its cut, so a table with a row per source decides
    on every document where it lies. Rows that are equal in doc_id, source and text are alike; if the cut falls among
    such rows, they go through one of them, as often as they are taken together.
    """
    rows = written(placed(docs, weights, share, most, seed, {"text_key": F.xxhash64("text")}), "mix-placed")
    at, in_ = F.struct("key", "text_key"), F.col("prefix") < F.col("left")
    last = written(rows.groupBy("source").agg(F.max(F.when(in_, at)).alias("cut"), F.first("epochs").alias("epochs")), "mix-cuts")
    a, c = rows.select("source", at.alias("at"), in_.alias("in_")).alias("a"), last.alias("c")
    alike = a.join(c, F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.at") == F.col("c.cut"))).groupBy("a.source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_"), 1)).alias("n_in"))
    n = alike.alias("n")
    ends = c.join(n, F.col("n.source").eqNullSafe(F.col("c.source")), "left")
    cuts = written(ends.select(F.col("c.source").alias("source"), "cut", "epochs", F.coalesce("n.n", F.lit(0)).alias("n"), F.coalesce("n.n_in", F.lit(0)).alias("n_in")), "mix-cuts")

    own = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), "source", F.struct(key_of(seed).alias("key"), F.xxhash64("text").alias("text_key")).alias("at"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("words"))
    o, c = own.alias("o"), cuts.alias("c")
    joined = o.join(c, F.col("o.source").eqNullSafe(F.col("c.source"))).select("row", "o.source", "at", "words", "cut", "epochs", "n", "n_in")
    many = F.col("words") & F.coalesce(F.col("at") == F.col("cut"), F.lit(False)) & (F.col("n") > 1)
    once = F.when(~F.col("words"), F.lit(1)).otherwise(F.col("epochs") + F.coalesce(F.col("at") <= F.col("cut"), F.lit(False)).cast("int"))
    single = joined.where(~many).select("row", once.cast("int").alias("copies"))
    group = joined.where(many).dropDuplicates(["source", "at"]).select("row", (F.col("n") * F.col("epochs") + F.col("n_in")).cast("int").alias("copies"))
    kept = single.unionByName(group).where("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixture(spark, sf_dir: str) -> DataFrame:
    """Contract of op6, over all of ``documents``."""
    return mix(table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents", seed: str = SEED) -> str:
    """The same rows in DuckDB SQL."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (rank - 1) % 3] AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per)),
lv AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(2 * coalesce(sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
lvl AS (SELECT level FROM lv WHERE level * weight <= 2 * source_size ORDER BY source_size / CAST(weight AS DOUBLE), rank LIMIT 1),
goal AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce((SELECT level FROM lvl) * weight, CAST(2 * source_size AS DOUBLE))) AS target FROM lv),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix,
         CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - prefix)) AS BIGINT) AS taken
FROM placed"""
