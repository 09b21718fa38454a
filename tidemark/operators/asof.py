"""Point-in-time joins: what was known on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, value: str, most_days: int | None = None) -> DataFrame:
    """left with the latest ``value`` of right at or before ``at`` (null beyond ``most_days``): union and last value, one sort per key, no range join."""
    cols = [c for c in left.columns]
    a = left.select(*cols, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[seen].dataType).alias("_s"))
    b = right.select(key, F.col(seen).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(seen).alias("_s"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b, allowMissingColumns=True)
    u = u.withColumn("_lv", F.last("_v", ignorenulls=True).over(w)).withColumn("_ls", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if most_days is None else F.datediff(F.col(at), F.col("_ls")) <= most_days
    return u.select(*cols, F.when(fresh, F.col("_lv")).alias(value))


def first_after(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, columns: list[str]) -> DataFrame:
    """left with ``columns`` of right's first row strictly after ``at``."""
    cols = left.columns
    a = left.select(*cols, F.col(at).alias("_t"), F.lit(1).alias("_side"))
    b = right.select(key, F.col(seen).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(seen).alias("_seen"), *columns).alias("_v"))
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_n", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return u.select(*cols, F.col("_n._seen").alias("anchor_date"), *(F.col(f"_n.{c}").alias(c) for c in columns))


def member(date: Column, start: Column, end: Column) -> Column:
    """From ``start`` on, before ``end``; open where either is null."""
    return F.coalesce(date >= start, F.lit(True)) & F.coalesce(date < end, F.lit(True))


def within_days(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, days: int) -> DataFrame:
    """Pairs with ``seen`` in (at - days, at]: each right row is filed under the windows it may fall in, so the join is on equal keys."""
    a = left.withColumn("_w", F.floor(F.unix_date(at) / days))
    b = right.withColumn("_w", F.explode(F.array(F.floor(F.unix_date(seen) / days), F.floor(F.unix_date(seen) / days) + 1)))
    return a.join(b, [key, "_w"]).where((F.col(seen) <= F.col(at)) & (F.col(seen) > F.date_sub(at, days))).drop("_w")


def sentiment(pairs: DataFrame, by: list[str], age: Column, score: Column, neutral: Column, least: int = 3, half_life: float = 7.0) -> DataFrame:
    """by, articles, mean, score (50 + 50 * mean; 50 where it is not known), newest age. Weight: halved each ``half_life`` days, less what is neutral."""
    clip = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))
    w = F.pow(F.lit(0.5), age / half_life) * clip(1 - neutral, 0.0)
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("articles"), F.sum(w * clip(score, -1.0)).alias("_a"), F.sum(w).alias("_w"), F.min(age).alias("newest"))
    mean = F.when((F.col("articles") >= least) & (F.col("_w") > 0), F.col("_a") / F.col("_w"))
    return g.select(*by, "articles", mean.alias("mean"), F.coalesce(50 + 50 * mean, F.lit(50.0)).alias("score"), "newest")


def sentiment_of(articles: Column, age, score, neutral, least: int = 3, half_life: float = 7.0) -> Column:
    """The score of ``sentiment`` from an array of articles; null where there is none. age, score, neutral: of an article."""
    clip = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))
    weight = lambda x: F.pow(F.lit(0.5), age(x) / half_life) * clip(1 - neutral(x), 0.0)
    total = lambda f: F.aggregate(articles, F.lit(0.0), lambda s, x: s + f(x))
    w = total(weight)
    mean = F.when(w > 0, total(lambda x: weight(x) * clip(score(x), -1.0)) / w)
    return F.when(F.size(articles) >= least, F.coalesce(50 + 50 * mean, F.lit(50.0))).when(F.size(articles) > 0, 50.0)


def trailing_quarters(quarters: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """key, as_of, known, eps4, eps4_before, days_since: of the 8 latest quarters whose results were out before the date. dates: key, as_of."""
    j = dates.join(quarters, key).where(F.col("available_at") < F.col("as_of"))
    j = j.withColumn("k", F.row_number().over(Window.partitionBy(key, "as_of").orderBy(F.desc("period_end")))).where("k <= 8")
    four = lambda lo, hi: F.when(F.count(F.when(F.col("k").between(lo, hi), 1)) == 4, F.sum(F.when(F.col("k").between(lo, hi), F.col("eps"))))
    return j.groupBy(key, "as_of").agg(F.count(F.lit(1)).alias("known"), four(1, 4).alias("eps4"), four(5, 8).alias("eps4_before"), F.min(F.datediff("as_of", "available_at")).alias("days_since"))
