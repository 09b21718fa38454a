"""Trades, folds, the book, bootstraps; splits and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import cross as X
from ..operators import factors as E
from ..operators import series as S
from ..operators import simulate as M
from ..sources.market import SQL_BARS, SQL_MONTHS, bars_daily, bars_monthly, table
from .cross_queries import monthly_panel
from .registry import query, r
from .series_queries import KEYS, W

CONFIGS = [M.Exits(f"d{d}-t{a:g}-{b:g}", d, a, b) for d in (7, 14, 21, 30) for a, b in ((1.5, 2.5), (2.0, 3.0), (2.0, 4.0), (3.0, 5.0))]


def signals(spark, sf) -> DataFrame:
    """Daily bars with levels; a signal where the close is over its EMA 20 and the stop is apart."""
    m = S.indicators(bars_daily(spark, sf)).withColumn("low15", F.min("low").over(S.last(15)))
    lv = E.levels(F.col("low15"))
    return m.withColumn("stop", F.coalesce(lv["stop"], F.lit(0.0))).withColumn("signal", F.coalesce((F.col("close") > F.col("ema20")) & F.col("atr14").isNotNull(), F.lit(False)))


@query()
def simulated_trades(spark, sf) -> DataFrame:
    """Every signal under 4 x 4 exits; configurations are rows, and an instrument's bars are read once for all of them."""
    return M.trades(signals(spark, sf), CONFIGS)


@query()
def sweep_metrics(spark, sf) -> DataFrame:
    return X.trade_metrics(M.trades(signals(spark, sf), CONFIGS), "net", ["config"], ["exit_date", "instrument_id", "signal_date"])


@query()
def walk_forward(spark, sf) -> DataFrame:
    cal = bars_daily(spark, sf).select("trade_date").distinct()
    return M.walk_forward(M.trades(signals(spark, sf), CONFIGS), M.folds(cal, 3, 2))


@query()
def portfolio(spark, sf) -> DataFrame:
    return M.book(M.trades(signals(spark, sf), CONFIGS[:4]))


@query()
def bootstrap_ic(spark, sf) -> DataFrame:
    ic = X.spearman(monthly_panel(spark, sf), "score", "fwd", ["subject", "h", "trade_date"]).withColumn("series", F.concat_ws("-", "subject", "h"))
    return M.stationary_bootstrap(ic, "ic", "trade_date", "series", reps=10_000, block=20, seed=12345)


@query(f"""WITH {SQL_BARS}, {SQL_MONTHS}, c AS (SELECT DISTINCT trade_date FROM months), n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, floor(count(*) OVER () / 4) AS size FROM c), k AS (SELECT * FROM n, (SELECT unnest([1, 2, 3]) AS fold))
SELECT fold, min(trade_date) FILTER (WHERE i < fold * size) AS train_from, max(trade_date) FILTER (WHERE i < fold * size) AS train_to,
 min(trade_date) FILTER (WHERE i >= fold * size + 2 AND (fold = 3 OR i < (fold + 1) * size)) AS test_from, max(trade_date) FILTER (WHERE i >= fold * size + 2 AND (fold = 3 OR i < (fold + 1) * size)) AS test_to FROM k GROUP BY fold""")
def folds(spark, sf) -> DataFrame:
    return M.folds(bars_monthly(bars_daily(spark, sf)).select("trade_date").distinct(), 3, 2)


@query(f"""WITH {SQL_BARS}, {SQL_MONTHS}, x AS (SELECT *, lag(close) OVER ({W}) / nullif(open, 0) AS q FROM months), y AS (SELECT *, CASE WHEN abs(q - 1) >= 0.35 AND q > 0 THEN q ELSE 1 END AS ratio FROM x),
f AS (SELECT *, exp(coalesce(sum(ln(ratio)) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS f FROM y)
SELECT instrument_id, trade_date, {r('ratio', 3)} AS ratio, {r('ln(f)', 3)} AS log_factor FROM f WHERE close > 0""")
def split_factors(spark, sf) -> DataFrame:
    m = bars_monthly(bars_daily(spark, sf))
    a = M.split_adjusted(m.withColumn("raw", F.col("close"))).where("raw > 0")
    return a.select(*KEYS, half_up(F.col("ratio"), 3).alias("ratio"), half_up(F.log(F.col("raw") / F.col("close")), 3).alias("log_factor"))


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS value, count(*) AS versions FROM events GROUP BY ALL) SELECT user_id, day, value, versions FROM x""")
def upserted(spark, sf) -> DataFrame:
    """The last write of each key wins."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("versions"))


@query(f"""WITH x AS (SELECT doc_id, n_chars AS score, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, floor((row_number() OVER (ORDER BY score, doc_id) - 1) * 5 / count(*) OVER ()) AS bucket FROM x)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, min(score) AS low, max(score) AS high, {r('avg(y)')} AS mean FROM b GROUP BY bucket""")
def score_buckets(spark, sf) -> DataFrame:
    """Equal counts by score: what a condition on it is worth. Bounds of buckets come from ranks summed over ranges of the score."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").alias("score"), F.col("quality").cast("double").alias("y"))
    d = d.withColumn("range", F.floor(F.log2(F.greatest("score", F.lit(1))) * 8))
    per = d.groupBy("range").agg(F.count(F.lit(1)).alias("c"))  # a row per range of scores
    one = Window.partitionBy(F.lit(0))
    per = per.withColumn("before", F.coalesce(F.sum("c").over(one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_all", F.sum("c").over(one))
    j = d.join(per, "range").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("score", "doc_id")) - 1)
    return j.groupBy(F.floor(F.col("k") * 5 / F.col("n_all")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), half_up(F.avg("y")).alias("mean"))


@query(f"""WITH {SQL_BARS}, s AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN volume / nullif(avg(volume) OVER w, 0) END AS surge, CASE WHEN lead(close, 1) OVER ({W}) > 0 THEN (lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100 END AS fwd FROM bars WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n, floor((row_number() OVER (PARTITION BY trade_date ORDER BY surge, instrument_id) - 1) * 5 / count(*) OVER (PARTITION BY trade_date)) AS k FROM s WHERE surge IS NOT NULL AND fwd IS NOT NULL)
SELECT CAST(k AS BIGINT) AS bucket, count(*) AS n, {r('avg(fwd)', 3)} AS mean, {r('avg((fwd > 0)::INT) * 100', 2)} AS hit_rate FROM b WHERE n >= 10 GROUP BY k""")
def surge_study(spark, sf) -> DataFrame:
    """What follows a surge of volume, by its rank on the date; dates with ten names and more."""
    s = bars_daily(spark, sf).select(*KEYS, S.surge().alias("surge"), S.forward_return(5).alias("fwd")).where("surge IS NOT NULL AND fwd IS NOT NULL")
    b = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trade_date"))).withColumn("bucket", X.bucket(["surge", "instrument_id"], ["trade_date"], 5)).where("n >= 10")
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("fwd"), 3).alias("mean"), half_up(F.avg((F.col("fwd") > 0).cast("int")) * 100, 2).alias("hit_rate"))
