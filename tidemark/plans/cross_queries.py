"""Cross-sections: correlations of scores with what came after, buckets, factors, regimes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio
from ..operators import cross as X
from ..operators import factors as E
from ..operators import series as S
from ..sources.market import SQL_BARS, SQL_BENCH, SQL_MONTHS, SQL_SECTORS, bars_daily, bars_monthly, benchmark, sectors
from ..sources.shared import dealt, deals
from .registry import query, r
from .series_queries import _SQL_LABELS, KEYS, SQL_INDICATORS, W, labels_of

HORIZONS = (1, 3, 6)


def monthly_panel(spark, sf) -> DataFrame:
    """Scores of month ends in long form: subject, h, score, fwd."""
    m = bars_monthly(bars_daily(spark, sf))
    m = m.select(*KEYS, S.momentum(1, 12).alias("momentum"), (-S.momentum(0, 1)).alias("reversal"), *(S.forward_return(h).alias(f"f{h}") for h in HORIZONS))
    one = [F.struct(F.lit(s).alias("subject"), F.lit(h).alias("h"), F.col(s).alias("score"), F.col(f"f{h}").alias("fwd")) for s in ("momentum", "reversal") for h in HORIZONS]
    return m.select(*KEYS, F.explode(F.array(*one)).alias("x")).select(*KEYS, "x.*").where("score IS NOT NULL AND fwd IS NOT NULL")


_PANEL = f"""{SQL_BARS}, {SQL_MONTHS}, mp AS (SELECT instrument_id, trade_date, lag(close, 1) OVER ({W}) / lag(close, 12) OVER ({W}) - 1 AS momentum, -(close / lag(close, 1) OVER ({W}) - 1) AS reversal,
  {", ".join(f"CASE WHEN lead(close, 1) OVER ({W}) > 0 THEN (lead(close, {1 + h}) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100 END AS f{h}" for h in HORIZONS)} FROM months),
panel AS ({" UNION ALL ".join(f"SELECT instrument_id, trade_date, '{s}' AS subject, {h} AS h, {s} AS score, f{h} AS fwd FROM mp WHERE {s} IS NOT NULL AND f{h} IS NOT NULL" for s in ("momentum", "reversal") for h in HORIZONS)})"""
_IC = """rk AS (SELECT subject, h, trade_date, rank() OVER (PARTITION BY subject, h, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY subject, h, trade_date, score) - 1) / 2 AS x,
   rank() OVER (PARTITION BY subject, h, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY subject, h, trade_date, fwd) - 1) / 2 AS y FROM panel),
su AS (SELECT subject, h, trade_date, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM rk GROUP BY ALL HAVING count(*) >= 5),
ic AS (SELECT subject, h, trade_date, n, floor(CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0 END * 1e3 + 0.5) / 1e3 AS ic FROM su)"""


@query(f"""WITH {_PANEL}, {_IC},
d AS (SELECT *, row_number() OVER (PARTITION BY subject, h ORDER BY trade_date) AS i, ic - avg(ic) OVER (PARTITION BY subject, h) AS e, greatest(1, floor(4 * pow(count(*) OVER (PARTITION BY subject, h) / 100, 2.0::DOUBLE / 9))) AS l FROM ic),
s AS (SELECT subject, h, count(*) AS t_obs, avg(ic) AS mean, stddev_samp(ic) AS sd, any_value(l) AS l, sum(e * e) AS s0 FROM d GROUP BY subject, h),
g AS (SELECT a.subject, a.h, sum(2 * (1 - (b.i - a.i) / (a.l + 1)) * a.e * b.e) AS sl FROM d a JOIN d b ON a.subject = b.subject AND a.h = b.h AND b.i > a.i AND b.i - a.i <= a.l GROUP BY a.subject, a.h)
SELECT subject, h, t_obs, {r('mean')} AS mean, {r('sd')} AS sd, {r('mean / sd')} AS ir, {r('mean / sd * sqrt(t_obs)')} AS t, {r('CASE WHEN s0 + sl > 0 THEN mean / sqrt((s0 + sl) / t_obs / t_obs) ELSE 0 END')} AS nw_t
FROM s JOIN g USING (subject, h)""")
def rank_ic(spark, sf) -> DataFrame:
    """The flagship: rank correlation of momentum and reversal with what followed, per month, and its significance."""
    ic = X.spearman(monthly_panel(spark, sf), "score", "fwd", ["subject", "h", "trade_date"])
    s = X.series_summary(ic, "ic", "trade_date", ["subject", "h"])
    return s.select("subject", "h", "t_obs", *(half_up(F.col(c)).alias(c) for c in ("mean", "sd", "ir", "t", "nw_t")))


@query(f"WITH {_PANEL}, {_IC} SELECT subject, h, trade_date, n, ic FROM ic")
def rank_ic_series(spark, sf) -> DataFrame:
    return X.spearman(monthly_panel(spark, sf), "score", "fwd", ["subject", "h", "trade_date"]).select("subject", "h", "trade_date", "n", "ic")


_DECILES = f"""WITH {SQL_BARS}, x AS (SELECT instrument_id, trade_date, lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1 AS score,
  CASE WHEN lead(close, 1) OVER ({W}) > 0 THEN (lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100 END AS fwd,
  ln(median(CASE WHEN close * volume > 0 THEN close * volume END) OVER ({W} ROWS 19 PRECEDING)) AS la FROM bars),
b AS (SELECT *, floor((row_number() OVER (PARTITION BY trade_date ORDER BY score, instrument_id) - 1) * 10 / count(*) OVER (PARTITION BY trade_date)) AS decile FROM x WHERE score IS NOT NULL AND fwd IS NOT NULL),
g AS (SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, avg(fwd) AS mean, sum(exp(la) * fwd) / sum(exp(la)) AS weighted, median(fwd) AS median FROM b GROUP BY decile)"""


def _deciles(spark, sf) -> DataFrame:
    b = bars_daily(spark, sf).select(*KEYS, S.momentum(21, 252).alias("score"), S.forward_return(5).alias("fwd"), S.log_adv().alias("la")).withColumn("w", F.exp("la"))
    return X.decile_returns(b, "score", "fwd", "w", "trade_date", "instrument_id")


@query(_DECILES + f" SELECT decile, n, {r('mean', 3)} AS mean, {r('weighted', 3)} AS weighted, {r('median', 3)} AS median FROM g")
def decile_portfolios(spark, sf) -> DataFrame:
    return _deciles(spark, sf).select("decile", "n", *(half_up(F.col(c), 3).alias(c) for c in ("mean", "weighted", "median")))


@query(_DECILES + f", s AS (SELECT *, lag(mean) OVER (ORDER BY decile) AS p FROM g) SELECT {r('arg_max(mean, decile) - arg_min(mean, decile)', 3)} AS spread, {r('avg(CASE WHEN mean >= p THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE p IS NOT NULL)')} AS monotonic FROM s")
def decile_spread(spark, sf) -> DataFrame:
    """Last less first bucket, and the share of steps that don't fall; over one row per bucket."""
    d = _deciles(spark, sf).withColumn("p", F.lag("mean").over(Window.partitionBy(F.lit(0)).orderBy("decile")))
    return d.agg(half_up(F.max_by("mean", "decile") - F.min_by("mean", "decile"), 3).alias("spread"), half_up(F.avg(F.when(F.col("p").isNotNull(), (F.col("mean") >= F.col("p")).cast("double")))).alias("monotonic"))


_F = f"""WITH {SQL_INDICATORS}, {SQL_BENCH}, {SQL_SECTORS},
bm AS (SELECT trade_date, (bench - lag(bench, 60) OVER (ORDER BY trade_date)) / lag(bench, 60) OVER (ORDER BY trade_date) * 100 AS b60 FROM benchmark_days),
x AS (SELECT ind.*, sector, CASE WHEN lag(close, 60) OVER w > 0 THEN (close - lag(close, 60) OVER w) / lag(close, 60) OVER w * 100 END AS r60,
  CASE WHEN lag(close, 5) OVER w > 0 THEN (close - lag(close, 5) OVER w) / lag(close, 5) OVER w * 100 END AS r5,
  CASE WHEN count(*) OVER w20 = 20 THEN avg(volume) OVER w5 / nullif(avg(volume) OVER w20, 0) END AS rel, b60
  FROM ind JOIN sectors USING (instrument_id) LEFT JOIN bm USING (trade_date)
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ind.trade_date), w20 AS (PARTITION BY instrument_id ORDER BY ind.trade_date ROWS 19 PRECEDING), w5 AS (PARTITION BY instrument_id ORDER BY ind.trade_date ROWS 4 PRECEDING)),
f AS (SELECT *, CASE WHEN ema200 IS NULL THEN 0 ELSE 25 * (close > ema20)::INT + 25 * (ema20 > ema50)::INT + 25 * (ema50 > ema200)::INT + 25 * (close > ema200)::INT END::DOUBLE AS trend,
  CASE WHEN macd_signal IS NULL OR rsi14 IS NULL THEN 0 ELSE 0.5::DOUBLE * (50 * (macd > 0)::INT + 50 * (macd > macd_signal)::INT) + 0.5::DOUBLE * rsi14 END AS momentum,
  coalesce(50 + 50 * greatest(-1, least(1, (r60 - b60) / 20)), 0) AS rs,
  CASE WHEN r60 IS NULL OR count(r60) OVER (PARTITION BY trade_date, sector) < 3 THEN 50 ELSE (rank() OVER (PARTITION BY trade_date, sector ORDER BY r60 NULLS LAST) - 1 + 0.5::DOUBLE * count(r60) OVER (PARTITION BY trade_date, sector, r60)) / count(r60) OVER (PARTITION BY trade_date, sector) * 100 END AS srs,
  coalesce(50 + sign(r5) * greatest(0, least(1, rel - 1)) * 50, 0) AS vol, coalesce(greatest(0, least(1, (6 - atr14 / close * 100) / 4.5::DOUBLE)) * 100, 50) AS calm FROM x)"""
FACTORS = ("trend", "momentum", "rs", "srs", "vol", "calm")


def bar_factors() -> dict[str, Column]:
    """Factors that hang on a bar's own indicators alone."""
    return {"trend": E.trend(), "momentum": E.momentum(), "calm": E.volatility()}


def factor_panel(spark, sf, ind: DataFrame | None = None, along=lambda x: x) -> DataFrame:
    """All factors on every bar of ``with_indicators``: the series are there by instrument, one shuffle by date makes the cross-sections. ``along``: what else is taken along the series. ``ind`` may have ``bar_factors`` in place of indicators."""
    ind = with_indicators(spark, sf) if ind is None else ind
    x = E.relative_strength(ind, benchmark(bars_of(ind))).withColumn("r60", S.lookback_return(60))
    x = x.withColumns({k: c for k, c in bar_factors().items() if k not in ind.columns}).withColumn("vol", E.volume())
    return E.sector_strength(along(x).join(sectors(spark, sf), "instrument_id").repartition("trade_date"), "r60")


@query(_F + f" SELECT instrument_id, trade_date, {', '.join(f'{r(c, 3)} AS {c}' for c in FACTORS)} FROM f")
def factor_scores(spark, sf) -> DataFrame:
    return factor_panel(spark, sf).select(*KEYS, *(half_up(F.col(c), 3).alias(c) for c in FACTORS))


_WEIGHTS = {"trend": 0.3, "momentum": 0.2, "rs": 0.25, "srs": 0.25}
_COMP = "(trend * 0.3::DOUBLE + momentum * 0.2::DOUBLE + rs * 0.25::DOUBLE + srs * 0.25::DOUBLE) / (0.3::DOUBLE + 0.2 + 0.25 + 0.25)"


@query(_F + f""", g AS (SELECT *, {r(_COMP, 2)} AS composite, list_aggregate([trend, momentum, rs, srs], 'stddev_pop') AS sd FROM f)
SELECT instrument_id, trade_date, composite, {r('greatest(0, least(1, 1 - sd / 50))', 3)} AS agreement,
  CASE WHEN NOT coalesce(composite >= 65, false) THEN 'composite' WHEN NOT coalesce(macd > macd_signal, false) THEN 'macd' WHEN NOT coalesce(close > ema20, false) THEN 'ema20'
       WHEN NOT coalesce({r('rsi14', 2)} BETWEEN 35 AND 68, false) THEN 'rsi' END AS failed FROM g WHERE ema200 IS NOT NULL""")
def strategy_gates(spark, sf) -> DataFrame:
    """Composite of factors, agreement among them, and the first gate that fails (null: all hold)."""
    p = factor_panel(spark, sf).where("ema200 IS NOT NULL").withColumn("composite", half_up(E.composite(_WEIGHTS), 2))
    gates = [("composite", F.col("composite") >= 65), ("macd", F.col("macd") > F.col("macd_signal")), ("ema20", F.col("close") > F.col("ema20")), ("rsi", half_up(F.col("rsi14"), 2).between(35, 68))]
    return p.select(*KEYS, "composite", half_up(E.agreement(list(_WEIGHTS)), 3).alias("agreement"), E.first_failed(gates).alias("failed"))


@query(f"""WITH {SQL_INDICATORS}, lo AS (SELECT *, min(low) OVER ({W} ROWS 14 PRECEDING) AS low15 FROM ind),
s AS (SELECT *, greatest(close - CASE WHEN atr14 / close * 100 < 1.5 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END * atr14, low15 * 0.997::DOUBLE) AS stop FROM lo WHERE rn >= 60 AND atr14 IS NOT NULL AND close > 0)
SELECT instrument_id, trade_date, {r('stop', 3)} AS stop, {r('close + 2 * (close - stop)', 3)} AS target1, {r('close + 3 * (close - stop)', 3)} AS target2,
  CASE WHEN atr14 / close * 100 >= 6 THEN 'too_volatile' WHEN (close - stop) / close * 100 < 0.5 OR (close - stop) / close * 100 > 10 THEN 'stop_distance' END AS reject FROM s""")
def signal_levels(spark, sf) -> DataFrame:
    ind = S.indicators(bars_daily(spark, sf)).withColumn("rn", F.row_number().over(S.by())).withColumn("low15", F.min("low").over(S.last(15)))
    lv = E.levels(F.col("low15"))
    return ind.where("rn >= 60 AND atr14 IS NOT NULL AND close > 0").select(*KEYS, *(half_up(lv[c], 3).alias(c) for c in ("stop", "target1", "target2")), lv["reject"].alias("reject"))


# The mean of these bars moves by tens of per cent a day and a quarter of the names is over its mean: bounds at which every regime holds on days of sf0.01.
BOUNDS = E.RegimeBounds(crash_drop=55.0, high_atr=72.0, bull_breadth=24.0, bear_breadth=22.0)
SQL_REGIME = f"""br AS (SELECT trade_date, {r('avg((close > ema50)::INT) * 100', 1)} AS breadth FROM ind WHERE ema50 IS NOT NULL GROUP BY trade_date),
bn AS (SELECT *, abs(bench - before) AS tr, avg(bench) OVER (ORDER BY trade_date ROWS 199 PRECEDING) AS m, avg(abs(bench - before)) OVER (ORDER BY trade_date ROWS 13 PRECEDING) AS ma
  FROM (SELECT trade_date, bench, row_number() OVER (ORDER BY trade_date) AS rn, lag(bench) OVER (ORDER BY trade_date) AS before FROM benchmark_days)),
be AS (SELECT rn, NULL::DOUBLE AS ema, NULL::DOUBLE AS atr FROM bn WHERE rn = 1 UNION ALL
  SELECT bn.rn, CASE WHEN bn.rn = 200 THEN bn.m WHEN bn.rn > 200 THEN be.ema + (bn.bench - be.ema) * (2.0::DOUBLE / 201) END, CASE WHEN bn.rn = 15 THEN bn.ma WHEN bn.rn > 15 THEN (be.atr * 13 + bn.tr) / 14 END FROM be JOIN bn ON bn.rn = be.rn + 1),
bc AS (SELECT trade_date, bench, ema, {r('(bench - coalesce(before, bench)) / coalesce(before, bench) * 100', 2)} AS change, CASE WHEN bench > 0 THEN {r('coalesce(atr, 0) / bench * 100', 2)} ELSE 0 END AS atr_pct FROM bn JOIN be USING (rn)),
rg AS (SELECT bc.trade_date, change, breadth, atr_pct, CASE WHEN ema IS NULL THEN 'SIDEWAYS' WHEN change <= -{BOUNDS.crash_drop} THEN 'CRASH' WHEN atr_pct >= {BOUNDS.high_atr} THEN 'HIGH_VOL'
  WHEN bc.bench > ema AND breadth >= {BOUNDS.bull_breadth} THEN 'BULL' WHEN bc.bench <= ema AND breadth <= {BOUNDS.bear_breadth} THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM bc LEFT JOIN br USING (trade_date))"""


def with_indicators(spark, sf, bars: DataFrame | None = None) -> DataFrame:
    """Bars with INDICATORS, as a table dealt by instrument: what factors, regimes and the stack read, so that bars and series are made once a query. ``bars``: dealt by instrument into ``deals`` parts."""
    bars = bars_daily(spark, sf, dealt=deals(spark)) if bars is None else bars
    return dealt(S.indicators(bars), "indicators", "instrument_id")


def bars_of(ind: DataFrame) -> DataFrame:
    return ind.drop(*S.INDICATORS)


def regimes(spark, sf, ind: DataFrame | None = None) -> DataFrame:
    """trade_date, change, breadth, atr_pct, regime. ind: ``with_indicators``. There is no volatility index here; the benchmark has closes only."""
    ind = with_indicators(spark, sf) if ind is None else ind
    m = benchmark(bars_of(ind))
    one = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # the calendar: a row per date
    e = S.indicators(m.select(F.lit(0).alias("instrument_id"), "trade_date", *(F.col("bench").alias(c) for c in ("high", "low", "close"))))
    before = F.coalesce(F.lag("close").over(one), F.col("close"))
    x = e.select("trade_date", F.col("close").alias("bench"), "ema200", half_up((F.col("close") - before) / before * 100, 2).alias("change"), F.when(F.col("close") > 0, half_up(F.coalesce("atr14", F.lit(0.0)) / F.col("close") * 100, 2)).otherwise(0.0).alias("atr_pct"))
    x = x.join(E.breadth(ind), "trade_date", "left").withColumn("breadth", half_up(F.col("breadth"), 1))
    of_day = E.regime(F.col("change"), F.lit(None).cast("double"), F.col("atr_pct"), F.col("bench"), F.col("ema200"), F.col("breadth"), BOUNDS)
    return x.select("trade_date", "change", "breadth", "atr_pct", of_day.alias("regime"))


@query(f"WITH {SQL_INDICATORS}, {SQL_BENCH}, {SQL_REGIME} SELECT trade_date, change, breadth, atr_pct, regime FROM rg")
def market_regime(spark, sf) -> DataFrame:
    """Regime of every date from the benchmark's fall, its ATR, its EMA 200 and breadth."""
    return regimes(spark, sf)


@query(f"""WITH {SQL_BARS}, {SQL_BENCH}, {SQL_SECTORS}, {_SQL_LABELS},
a AS (SELECT instrument_id, trade_date, ln(median(CASE WHEN close * volume > 0 THEN close * volume END) OVER ({W} ROWS 19 PRECEDING)) AS a, ln(close) AS b FROM bars WHERE close > 0),
j AS (SELECT instrument_id, l.trade_date, sector, fwd AS y, a, b FROM labels l JOIN a USING (instrument_id, trade_date) JOIN sectors USING (instrument_id) WHERE h = 5 AND fwd IS NOT NULL AND a IS NOT NULL),
c AS (SELECT *, y - avg(y) OVER s AS cy, a - avg(a) OVER s AS ca, b - avg(b) OVER s AS cb FROM j WINDOW s AS (PARTITION BY trade_date, sector)),
t AS (SELECT trade_date, count(*) AS n, count(DISTINCT sector) + 2 AS k, sum(ca * ca) AS aa, sum(ca * cb) AS ab, sum(cb * cb) AS bb, sum(ca * cy) AS ay, sum(cb * cy) AS bq FROM c GROUP BY trade_date)
SELECT instrument_id, trade_date, {r('cy - (ay * bb - bq * ab) / (aa * bb - ab * ab) * ca - (bq * aa - ay * ab) / (aa * bb - ab * ab) * cb', 2)} AS residual FROM c JOIN t USING (trade_date) WHERE n >= 20 AND n > k AND aa * bb - ab * ab > 1e-12""")
def residual_labels(spark, sf) -> DataFrame:
    """5-bar labels less what size, price level and sector explain on each date."""
    bars = bars_daily(spark, sf)
    a = bars.where("close > 0").select(*KEYS, S.log_adv().alias("a"), F.log("close").alias("b"))
    j = labels_of(bars, (5,)).where("fwd IS NOT NULL").join(a, list(KEYS)).join(sectors(spark, sf), "instrument_id")
    return X.residuals(j, "fwd", ("a", "b"), "sector", "trade_date").where("residual IS NOT NULL").select(*KEYS, half_up(F.col("residual"), 2).alias("residual"))


@query(f"""WITH {SQL_BARS}, t AS (SELECT instrument_id, trade_date, (lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100 AS net FROM bars),
v AS (SELECT instrument_id, trade_date, {r('net', 2)} AS net FROM t WHERE net IS NOT NULL AND isfinite(net)),
q AS (SELECT *, sum(net) OVER ({W}) AS cum FROM v), d AS (SELECT *, greatest(0, max(cum) OVER ({W})) - cum AS dd FROM q)
SELECT instrument_id, count(*) AS n, {r('count(*) FILTER (WHERE net > 0) / count(*)::DOUBLE * 100', 2)} AS win_rate, {r('avg(net)', 3)} AS expectancy,
  {r('coalesce(sum(net) FILTER (WHERE net > 0), 0) / nullif(-sum(net) FILTER (WHERE net <= 0), 0)', 3)} AS profit_factor, {r('max(dd)', 2)} AS max_drawdown, {r('avg(net) / stddev_pop(net)', 3)} AS sharpe FROM d GROUP BY instrument_id""")
def trade_metrics(spark, sf) -> DataFrame:
    """Metrics of 5-bar trades entered on every bar, per instrument."""
    t = bars_daily(spark, sf).select(*KEYS, half_up(S.forward_return(5), 2).alias("net")).where("net IS NOT NULL")
    m = X.trade_metrics(t, "net", ["instrument_id"], ["trade_date"])
    return m.select("instrument_id", "n", half_up(F.col("win_rate"), 2).alias("win_rate"), *(half_up(F.col(c), p).alias(c) for c, p in (("expectancy", 3), ("profit_factor", 3), ("max_drawdown", 2), ("sharpe", 3))))
