"""Cross-sections: ranks, buckets, correlations and the statistics over their series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio
from ..sources.shared import written


def bucket(order: list, partition: list, buckets: int) -> Column:
    """0 .. buckets - 1 with floor(rank * buckets / size): sizes differ from those of ntile."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) * buckets / n)


def mid_rank(x: str, partition: list) -> Column:
    """Average rank of ties, from 1."""
    below = F.rank().over(Window.partitionBy(*partition).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, x))
    return below + (ties - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list, least: int = 5, dp: int | None = 3) -> DataFrame:
    """by, n, ic: tie-averaged rank correlation per group of ``least`` rows and more; 0 where a side does not vary.

    Ranks are sums of halves, so every sum here is exact and does not hang on order. ``dp`` rounds each value, as published series do; None doesn't.
    """
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", mid_rank(x, by)).withColumn("_y", mid_rank(y, by))
    s = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_y") * F.col("_y")).alias("syy")).where(F.col("n") >= least)
    return s.select(*by, "n", rank_correlation(dp).alias("ic"))


def rank_correlation(dp: int | None = 3) -> Column:
    """From n and sums of ranks; 0 where a side does not vary."""
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    ic = F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(F.lit(0.0))
    return half_up(ic, dp) if dp is not None else ic


def series_summary(series: DataFrame, value: str, date: str, by: list, lags: int | str | None = None) -> DataFrame:
    """by, t_obs, mean, sd, ir, t, nw_t: Newey-West with Bartlett weights; lags by the rule of thumb unless given, as a number or as a column of ``by``.

    Lags count the dates in the series. One group is one series of a value a date.
    """
    w = Window.partitionBy(*by)
    base = series.withColumn("_m", F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_d", F.col(value) - F.col("_m"))
    rule = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("_n") / 100, F.lit(2 / 9)))) if lags is None else F.col(lags) if isinstance(lags, str) else F.lit(lags)
    base = base.withColumn("_l", rule.cast("int")).withColumn("_i", F.row_number().over(w.orderBy(date)))
    arr = base.groupBy(*by).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), F.first("_l").alias("l"), F.stddev_samp(value).alias("sd"), F.sort_array(F.collect_list(F.struct("_i", "_d"))).alias("a"))
    d = F.transform("a", lambda x: x["_d"])
    arr = arr.withColumn("d", d).withColumn("s0", F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x * x))
    lagged = F.aggregate(
        F.sequence(F.lit(1), F.col("l")), F.lit(0.0),
        lambda acc, k: acc + 2 * (1 - k / (F.col("l") + 1)) * F.aggregate(F.zip_with(F.slice("d", k + 1, F.size("d")), F.slice("d", F.lit(1), F.greatest(F.size("d") - k, F.lit(0))), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda b, x: b + x),
    )
    var = (F.col("s0") + lagged) / F.col("n")
    nw = F.when(var > 0, F.col("mean") / F.sqrt(var / F.col("n"))).otherwise(F.lit(0.0))
    ir = ratio(F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0)))
    return arr.select(*by, F.col("n").alias("t_obs"), "mean", "sd", ir.alias("ir"), (ir * F.sqrt("n")).alias("t"), nw.alias("nw_t"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, and an exact quantile (between two values: in proportion) for each name in ``shares``.

    Values are counted by ranges, on a scale of their logarithms; sums over ranges tell in which one a wanted rank lies, and only
    the rows of those ranges are sorted. So no task holds a group's values, as an aggregate of percentiles does.
    """
    x = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_g", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 64))
    w = Window.partitionBy(*by)
    per = x.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("_c"))  # a row per range
    per = per.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    sides = F.array(*(F.struct(F.lit(k).alias("name"), f(at(p)).cast("long").alias("rank"), (at(p) - F.floor(at(p))).alias("part"), F.lit(i).alias("side")) for k, p in shares.items() for i, f in enumerate((F.floor, F.ceil))))
    want = per.withColumn("_w", F.explode(sides)).where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_c")))
    want = want.groupBy(*by, "_g", "_before").agg(F.collect_list("_w").alias("_w"))  # at most two a share and group
    rows = x.join(want, [*by, "_g"]).withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_g").orderBy("_v")) - 1)
    hit = rows.where(F.exists("_w", lambda z: z["rank"] == F.col("_k"))).withColumn("_w", F.explode("_w")).where("_w.rank = _k")
    end = lambda k, i: F.max(F.when((F.col("_w.name") == k) & (F.col("_w.side") == i), F.col("_v")))
    part = lambda k: F.max(F.when(F.col("_w.name") == k, F.col("_w.part")))
    return hit.groupBy(*by).agg(*((end(k, 0) + (end(k, 1) - end(k, 0)) * part(k)).alias(k) for k in shares))


def decile_returns(df: DataFrame, score: str, ret: str, weight: str | None, date: str, tie: str, buckets: int = 10) -> DataFrame:
    """decile, n, mean, weighted mean (rows with a weight), median: buckets per date, pooled over dates."""
    # Written once: sums, counts of ranges and the rows of the ranges that a median lies in are all read from it.
    b = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).withColumn("decile", bucket([score, tie], [date], buckets))
    b = written(b.select("decile", ret, *([weight] if weight else [])), "deciles")
    w = F.col(weight) if weight else F.lit(1.0)
    sums = b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), ratio(F.sum(w * F.col(ret)), F.sum(F.when(w.isNotNull(), w))).alias("weighted"))
    return sums.join(quantiles(b, ret, ["decile"], {"median": 0.5}), "decile")


def residuals(df: DataFrame, y: str, xs: tuple[str, str], sector: str, date: str, least: int = 20) -> DataFrame:
    """Per date, y less its regression on xs and sector dummies: sector means off, then 2 x 2 normal equations.

    Null where the cross-section has fewer than ``least`` rows, no more rows than parameters, or the equations are singular.
    """
    d, s = Window.partitionBy(date), Window.partitionBy(date, sector)
    # Dealt by date once: a sector of a date is where its date is.
    have = df.where(F.col(y).isNotNull() & F.col(xs[0]).isNotNull() & F.col(xs[1]).isNotNull()).repartition(date)
    for name, col in (("_y", y), ("_a", xs[0]), ("_b", xs[1])):
        have = have.withColumn(name, F.col(col) - F.avg(col).over(s))
    tot = {n: F.sum(F.col(p) * F.col(q)).over(d) for n, p, q in (("aa", "_a", "_a"), ("ab", "_a", "_b"), ("bb", "_b", "_b"), ("ay", "_a", "_y"), ("by", "_b", "_y"))}
    for n, c in tot.items():
        have = have.withColumn(n, c)
    have = have.withColumn("n", F.count(F.lit(1)).over(d)).withColumn("k", F.size(F.collect_set(sector).over(d)) + 2).withColumn("det", F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"))
    ok = (F.col("n") >= least) & (F.col("n") > F.col("k")) & (F.col("det") > 1e-12)
    ba = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), F.col("det"))
    bb = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), F.col("det"))
    return have.withColumn("residual", F.when(ok, F.col("_y") - ba * F.col("_a") - bb * F.col("_b"))).drop("_y", "_a", "_b", *tot, "n", "k", "det")


def trade_metrics(trades: DataFrame, net: str, by: list, order: list) -> DataFrame:
    """Counts, win rate, expectancy, profit factor, drawdown of the running sum, Sharpe and Sortino by population deviation."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = trades.withColumn("_cum", F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_dd", F.greatest(F.lit(0.0), F.max("_cum").over(w.rowsBetween(Window.unboundedPreceding, 0))) - F.col("_cum"))
    gain, loss = F.when(F.col(net) > 0, F.col(net)), F.when(F.col(net) <= 0, F.col(net))
    a = run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(gain).alias("wins"), F.avg(net).alias("expectancy"), F.avg(gain).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("_g"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_l"), F.max("_dd").alias("max_drawdown"), F.stddev_pop(net).alias("_sd"), F.stddev_pop(loss).alias("_sl"), F.max(net).alias("best"), F.min(net).alias("worst"),
    )
    pf = F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).when(F.col("_g") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(*by, "n", (F.col("wins") / F.col("n") * 100).alias("win_rate"), "expectancy", zero(F.col("avg_win")).alias("avg_win"), zero(F.col("avg_loss")).alias("avg_loss"), pf.alias("profit_factor"), "max_drawdown",
                    zero(F.try_divide(F.col("expectancy"), F.col("_sd"))).alias("sharpe"), zero(F.try_divide(F.col("expectancy"), F.col("_sl"))).alias("sortino"), "best", "worst")
