"""Windows, labels and indicators along bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio
from ..operators import series as S
from ..operators.recurrence import SIZE
from ..sources.market import SQL_BARS, SQL_BENCH, bars_daily, benchmark
from ..sources.shared import deals
from .registry import query, r

KEYS = ("instrument_id", "trade_date")
W = "PARTITION BY instrument_id ORDER BY trade_date"


@query(f"WITH {SQL_BARS} SELECT instrument_id, trade_date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM bars")
def daily_bars(spark, sf) -> DataFrame:
    b = bars_daily(spark, sf)
    return b.select(*KEYS, *(half_up(F.col(x)).alias(x) for x in ("open", "high", "low", "close")), "volume")


@query(f"""WITH {SQL_BARS}, x AS (
  SELECT *, lag(close) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2 FROM bars)
SELECT 'ohlc' AS kind, count(*) AS n FROM x WHERE high < low OR high < greatest(open, close) OR low > least(open, close)
UNION ALL SELECT 'duplicate', coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM bars GROUP BY instrument_id, trade_date HAVING count(*) > 1)
UNION ALL SELECT 'jump', count(*) FROM x WHERE abs(close / c1 - 1) > 0.2
UNION ALL SELECT 'stale', count(*) FROM x WHERE close = c1 AND close = c2""")
def price_audit(spark, sf) -> DataFrame:
    """How many bars break a rule: order of prices, repeated keys, moves of over 20 %, three equal closes."""
    b = bars_daily(spark, sf)
    x = b.withColumn("c1", F.lag("close").over(S.by())).withColumn("c2", F.lag("close", 2).over(S.by())).withColumn("again", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)) > 1)
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    one = x.agg(n(bad).alias("ohlc"), n(F.col("again")).alias("duplicate"), n(F.abs(F.col("close") / F.col("c1") - 1) > 0.2).alias("jump"), n((F.col("close") == F.col("c1")) & (F.col("close") == F.col("c2"))).alias("stale"))
    return one.unpivot([], ["ohlc", "duplicate", "jump", "stale"], "kind", "n")


@query(f"""WITH {SQL_BARS}, g AS (
  SELECT instrument_id, count(*) AS n, min(trade_date) AS d0, max(trade_date) AS d1,
         sum(CASE WHEN isfinite(close) AND low > 0 AND volume >= 0 AND high >= low AND high >= greatest(open, close) AND low <= least(open, close) THEN 0 ELSE 1 END) AS bad
  FROM bars GROUP BY instrument_id), l AS (SELECT max(trade_date) AS today FROM bars),
c AS (SELECT g.*, today, (SELECT count(*) FROM range(g.d0, CAST(today + INTERVAL 1 DAY AS DATE), INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) AS days FROM g, l)
SELECT instrument_id, n, bad, {r("least(1.0::DOUBLE, n / greatest(1.0::DOUBLE, days * 0.94::DOUBLE)) * (1 - bad / n::DOUBLE) * CASE WHEN today - d1 > 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n < 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END")} AS score FROM c""")
def data_quality(spark, sf) -> DataFrame:
    """Score of each instrument's history: continuity, less malformed bars, halved if stale or short."""
    b = bars_daily(spark, sf)
    good = (F.col("low") > 0) & (F.col("volume") >= 0) & (F.col("high") >= F.col("low")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    g = b.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("d0"), F.max("trade_date").alias("d1"), F.sum((~good).cast("long")).alias("bad"))
    g = g.crossJoin(b.agg(F.max("trade_date").alias("today")))  # one row
    score = S.quality(F.col("n"), F.col("d0"), F.col("today"), F.col("bad"), F.col("d1"))
    return g.select("instrument_id", "n", "bad", half_up(score).alias("score"))


@query(f"""WITH {SQL_BARS}, x AS (SELECT instrument_id, trade_date,
  lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1 AS mom, close / lag(close, 5) OVER ({W}) - 1 AS rev,
  CASE WHEN lag(close, 60) OVER ({W}) > 0 THEN (close - lag(close, 60) OVER ({W})) / lag(close, 60) OVER ({W}) * 100 END AS ret60 FROM bars)
SELECT instrument_id, trade_date, {r('mom')} AS mom, {r('rev')} AS rev, {r('ret60')} AS ret60 FROM x WHERE mom IS NOT NULL""")
def controls(spark, sf) -> DataFrame:
    """Momentum over 12 months less the last one, 5-day reversal, 60-day return."""
    x = bars_daily(spark, sf).select(*KEYS, half_up(S.momentum(21, 252)).alias("mom"), half_up(S.momentum(0, 5)).alias("rev"), half_up(S.lookback_return(60)).alias("ret60"))
    return x.where("mom IS NOT NULL")


@query(f"""WITH {SQL_BARS}, x AS (SELECT instrument_id, trade_date,
  CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma20, CASE WHEN count(*) OVER w15 = 15 THEN min(low) OVER w15 END AS swing_low,
  CASE WHEN count(*) OVER w59 = 59 THEN max(high) OVER w59 END AS prior_high, close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars
  WINDOW w20 AS ({W} ROWS 19 PRECEDING), w15 AS ({W} ROWS 14 PRECEDING), w59 AS ({W} ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING))
SELECT instrument_id, trade_date, {r('sma20')} AS sma20, {r('swing_low')} AS swing_low, {r('prior_high')} AS prior_high, {r('drawdown')} AS drawdown FROM x""")
def rolling_levels(spark, sf) -> DataFrame:
    return bars_daily(spark, sf).select(*KEYS, half_up(S.full(F.avg("close"), 20)).alias("sma20"), half_up(S.full(F.min("low"), 15)).alias("swing_low"), half_up(S.full(F.max("high"), 59, 1)).alias("prior_high"), half_up(S.drawdown()).alias("drawdown"))


@query(f"""WITH {SQL_BARS}, x AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w END AS before, median(CASE WHEN close * volume > 0 THEN close * volume END) OVER ({W} ROWS 19 PRECEDING) AS turnover
  FROM bars WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT instrument_id, trade_date, {r('volume / nullif(before, 0)')} AS surge, {r('ln(turnover)')} AS log_adv FROM x""")
def volume_surge(spark, sf) -> DataFrame:
    return bars_daily(spark, sf).select(*KEYS, half_up(S.surge()).alias("surge"), half_up(S.log_adv()).alias("log_adv"))


_H = (1, 3, 5, 10, 21, 63)
_SQL_LABELS = f"""labels AS (
  SELECT b.instrument_id, b.trade_date, h, CASE WHEN c1 > 0 THEN (c2 - c1) / c1 * 100 END AS fwd,
         CASE WHEN b1.bench > 0 THEN (b2.bench - b1.bench) / b1.bench * 100 END AS mkt
  FROM ({" UNION ALL ".join(f"SELECT instrument_id, trade_date, {h} AS h, lead(close, 1) OVER ({W}) AS c1, lead(close, {1 + h}) OVER ({W}) AS c2, lead(trade_date, 1) OVER ({W}) AS d1, lead(trade_date, {1 + h}) OVER ({W}) AS d2 FROM bars" for h in _H)}) b
  LEFT JOIN benchmark_days b1 ON b1.trade_date = d1 LEFT JOIN benchmark_days b2 ON b2.trade_date = d2)"""


def labels_of(bars: DataFrame, horizons=_H) -> DataFrame:
    """instrument_id, trade_date, h, fwd, mkt: own forward return and the benchmark's between the same dates, per cent. Horizons are rows."""
    at = sorted({1, *(1 + h for h in horizons)})
    b = bars.select(*KEYS, *(F.lead(x, k).over(S.by()).alias(f"{x}{k}") for k in at for x in ("close", "trade_date")))
    b = b.select(*KEYS, F.col("close1").alias("c1"), F.col("trade_date1").alias("d1"), F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"close{1 + h}").alias("c2"), F.col(f"trade_date{1 + h}").alias("d2")) for h in horizons])).alias("x")).select(*KEYS, "c1", "d1", "x.*")
    m = benchmark(bars)
    j = b.join(m.select(F.col("trade_date").alias("d1"), F.col("bench").alias("b1")), "d1", "left").join(m.select(F.col("trade_date").alias("d2"), F.col("bench").alias("b2")), "d2", "left")
    pc = lambda now, then: F.when(F.col(then) > 0, (F.col(now) - F.col(then)) / F.col(then) * 100)
    return j.select(*KEYS, "h", pc("c2", "c1").alias("fwd"), pc("b2", "b1").alias("mkt"))


@query(f"WITH {SQL_BARS}, {SQL_BENCH}, {_SQL_LABELS} SELECT instrument_id, trade_date, h, {r('fwd')} AS fwd, {r('fwd - mkt')} AS excess FROM labels WHERE fwd IS NOT NULL")
def forward_labels(spark, sf) -> DataFrame:
    return labels_of(bars_daily(spark, sf)).where("fwd IS NOT NULL").select(*KEYS, "h", half_up(F.col("fwd")).alias("fwd"), half_up(F.col("fwd") - F.col("mkt")).alias("excess"))


@query(f"""WITH {SQL_BARS}, {SQL_BENCH}, j AS (
  SELECT instrument_id, b.trade_date, close / nullif(lag(close) OVER w, 0) - 1 AS r, bench / nullif(lag(bench) OVER w, 0) - 1 AS b
  FROM bars b JOIN benchmark_days USING (trade_date) WINDOW w AS (PARTITION BY instrument_id ORDER BY b.trade_date)),
p AS (SELECT *, count(*) OVER w AS n, covar_pop(r, b) OVER w AS c, var_pop(b) OVER w AS v FROM j WHERE r IS NOT NULL AND b IS NOT NULL WINDOW w AS ({W} ROWS 251 PRECEDING))
SELECT instrument_id, trade_date, {r('c / v')} AS beta FROM p WHERE n >= 20 AND v > 0""")
def trailing_beta(spark, sf) -> DataFrame:
    b = bars_daily(spark, sf)
    return S.trailing_beta(b, benchmark(b)).where("beta IS NOT NULL").select(*KEYS, half_up(F.col("beta")).alias("beta"))


def _recursive() -> str:
    """The recursions step by step in SQL: every state of a bar from the bar before."""
    def ema(x: str, p: int, name: str, seed: str) -> str:
        return f"CASE WHEN n.rn < {p} THEN NULL WHEN n.rn = {p} THEN {seed} ELSE e.{name} + ({x} - e.{name}) * (2.0::DOUBLE / {p + 1}) END AS {name}"

    def wilder(x: str, name: str) -> str:
        return f"CASE WHEN n.rn <= 14 THEN NULL WHEN n.rn = 15 THEN n.s_{name} ELSE (e.{name} * 13 + n.{x}) / 14 END AS {name}"

    return f"""num AS (SELECT *, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS c1 FROM bars),
ch AS (SELECT *, greatest(close - coalesce(c1, close), 0) AS gain, greatest(coalesce(c1, close) - close, 0) AS loss,
   greatest(high - low, abs(high - coalesce(c1, close)), abs(low - coalesce(c1, close))) AS tr FROM num),
st AS (SELECT *, {", ".join(f"avg(close) OVER ({W} ROWS {p - 1} PRECEDING) AS m{p}" for p in (12, 20, 26, 50, 200))},
   {", ".join(f"avg({x}) OVER ({W} ROWS 13 PRECEDING) AS s_{y}" for x, y in (("gain", "ag"), ("loss", "al"), ("tr", "atr")))} FROM ch),
e AS (SELECT instrument_id, trade_date, rn, {", ".join(f"NULL::DOUBLE AS {x}" for x in ("e12", "e20", "e26", "e50", "e200", "ag", "al", "atr"))} FROM st WHERE rn = 1
  UNION ALL SELECT n.instrument_id, n.trade_date, n.rn, {", ".join(ema("n.close", p, f"e{p}", f"n.m{p}") for p in (12, 20, 26, 50, 200))}, {wilder("gain", "ag")}, {wilder("loss", "al")}, {wilder("tr", "atr")}
  FROM e JOIN st n ON n.instrument_id = e.instrument_id AND n.rn = e.rn + 1),
ml AS (SELECT *, e12 - e26 AS line, avg(e12 - e26) OVER ({W} ROWS 8 PRECEDING) AS s9 FROM e),
sg AS (SELECT instrument_id, rn, NULL::DOUBLE AS sig FROM ml WHERE rn = 25
  UNION ALL SELECT n.instrument_id, n.rn, CASE WHEN n.rn < 34 THEN NULL WHEN n.rn = 34 THEN n.s9 ELSE sg.sig + (n.line - sg.sig) * (2.0::DOUBLE / 10) END
  FROM sg JOIN ml n ON n.instrument_id = sg.instrument_id AND n.rn = sg.rn + 1),
ind AS (SELECT instrument_id, trade_date, b.rn, open, high, low, close, volume, e20 AS ema20, e50 AS ema50, e200 AS ema200, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi14,
  line AS macd, sig AS macd_signal, atr AS atr14 FROM ml JOIN bars USING (instrument_id, trade_date) JOIN (SELECT instrument_id, trade_date, rn FROM num) b USING (instrument_id, trade_date) LEFT JOIN sg ON sg.instrument_id = ml.instrument_id AND sg.rn = ml.rn)"""


SQL_INDICATORS = f"RECURSIVE {SQL_BARS}, {_recursive()}".replace("ml.instrument_id AND sg.rn = ml.rn)", "ml.instrument_id AND sg.rn = ml.rn)")


@query(f"WITH {SQL_INDICATORS} SELECT instrument_id, trade_date, {', '.join(f'{r(x)} AS {x}' for x in S.INDICATORS)} FROM ind")
def indicators(spark, sf) -> DataFrame:
    """EMA 20, 50, 200; RSI 14; MACD 12-26-9; ATR 14 of every bar."""
    return S.indicators(bars_daily(spark, sf)).select(*KEYS, *(half_up(F.col(x)).alias(x) for x in S.INDICATORS))


@query(f"WITH {SQL_INDICATORS} SELECT instrument_id, trade_date, {', '.join(f'{r(x)} AS {x}' for x in S.INDICATORS)} FROM ind")
def indicator_scan(spark, sf) -> DataFrame:
    """The same numbers as a scan over blocks of bars."""
    return S.indicators_scan(bars_daily(spark, sf, dealt=deals(spark), block=SIZE)).select(*KEYS, *(half_up(F.col(x)).alias(x) for x in S.INDICATORS))


@query(f"""WITH {SQL_BARS}, x AS (SELECT *, lag(close) OVER ({W}) AS c1 FROM bars), d AS (SELECT trade_date, avg(close / c1 - 1) AS m FROM x WHERE c1 > 0 GROUP BY trade_date),
bh AS (SELECT instrument_id, (arg_max(close, trade_date) - arg_min(close, trade_date)) / arg_min(close, trade_date) * 100 AS r FROM bars GROUP BY instrument_id HAVING arg_min(close, trade_date) > 0)
SELECT {r('sum(ln(1 + m))', 2)} AS equal_weight_log, (SELECT {r('avg(r)', 2)} FROM bh) AS buy_and_hold FROM d""")
def benchmark_returns(spark, sf) -> DataFrame:
    """Log growth of the mean of the daily returns there are, and the mean of first-to-last returns, per cent."""
    b = bars_daily(spark, sf)
    daily = b.withColumn("x", ratio(F.col("close"), F.lag("close").over(S.by())) - 1).groupBy("trade_date").agg(F.avg("x").alias("m"))
    held = b.groupBy("instrument_id").agg(F.min_by("close", "trade_date").alias("a"), F.max_by("close", "trade_date").alias("z")).where("a > 0")
    return daily.agg(half_up(F.sum(F.log1p("m")), 2).alias("equal_weight_log")).crossJoin(held.agg(half_up(F.avg((F.col("z") - F.col("a")) / F.col("a") * 100), 2).alias("buy_and_hold")))
