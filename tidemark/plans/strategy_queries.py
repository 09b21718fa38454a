"""The production stack over bars: fundamentals and sentiment as factors, blend, gates, signals, allocation, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.strings import fallback_available
from ..operators import asof as A
from ..operators import cross as X
from ..operators import factors as E
from ..operators import grid as G
from ..operators import series as S
from ..operators import strategy as P
from ..sources.market import SQL_BARS, SQL_SECTORS, bars_daily, sectors, table
from ..sources.shared import dealt, deals, written
from .cross_queries import _F, SQL_REGIME, bar_factors, bars_of, factor_panel, regimes, with_indicators
from .registry import query, r
from .series_queries import KEYS, W

# ---------------------------------------------------------------- results and when they were known

# A quarter's earnings: what a supplier shipped less three times what came back; an urgent order stands for an announcement.
_RESULTS = """qr AS (SELECT l_suppkey AS instrument_id, CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end,
  sum(CASE WHEN l_returnflag = 'R' THEN -3 ELSE 1 END * l_quantity) AS eps FROM lineitem GROUP BY ALL),
an AS (SELECT 1 + o_custkey % (SELECT max(l_suppkey) FROM lineitem) AS instrument_id, o_orderdate + to_hours(o_orderkey % 24) AS told FROM orders WHERE o_orderpriority = '1-URGENT'),
am AS (SELECT qr.instrument_id, period_end, any_value(eps) AS eps, min(told) AS announced_at FROM qr LEFT JOIN an ON an.instrument_id = qr.instrument_id AND told > period_end AND told <= period_end + INTERVAL 75 DAY GROUP BY ALL),
av AS (SELECT *, CAST(coalesce(CAST(announced_at AS DATE), period_end + CAST(CASE WHEN month(period_end) = 3 THEN 60 ELSE 45 END AS INTEGER)) AS DATE) AS available,
  CAST(coalesce(CAST(announced_at AS DATE) + 1, period_end + CAST(CASE WHEN month(period_end) = 3 THEN 60 ELSE 45 END AS INTEGER)) AS DATE) AS usable_from FROM am)"""


def quarters(spark, sf) -> DataFrame:
    """instrument_id, period_end, eps, announced_at (the earliest announcement in the 75 days after), available, usable_from.

    An announcement during a day can be used from the next day on; the last legal day, which stands in for one, on the day itself.
    """
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    period = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    q = li.groupBy(F.col("l_suppkey").alias("instrument_id"), period.alias("period_end")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -3).otherwise(1) * F.col("l_quantity")).alias("eps"))
    top = li.agg(F.max("l_suppkey").alias("m"))  # one row
    told = o.where("o_orderpriority = '1-URGENT'").crossJoin(F.broadcast(top)).select((1 + F.col("o_custkey") % F.col("m")).alias("instrument_id"), F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate")).alias("told"))
    x = A.first_after(q.withColumn("end", F.col("period_end").cast("timestamp")), told, "instrument_id", "end", "told", [])
    announced = F.when(F.col("anchor_date") <= F.timestamp_add("DAY", F.lit(75), F.col("end")), F.col("anchor_date"))
    x = x.select("instrument_id", "period_end", "eps", announced.alias("announced_at"))
    day, late = F.to_date("announced_at"), fallback_available(F.col("period_end"))
    return x.withColumn("available", F.coalesce(day, late)).withColumn("usable_from", F.coalesce(F.date_add(day, 1), late))


@query(f"WITH {_RESULTS} SELECT instrument_id, period_end, eps, announced_at, available, usable_from FROM av")
def announced_results(spark, sf) -> DataFrame:
    """Quarters with their announcement, or the day by which it must have been made."""
    return quarters(spark, sf)


_FUND = f"""{_RESULTS}, ks AS (SELECT b.instrument_id, b.trade_date, b.close, av.*, row_number() OVER (PARTITION BY b.instrument_id, b.trade_date ORDER BY period_end DESC) AS k
  FROM bars b JOIN av ON av.instrument_id = b.instrument_id AND av.usable_from <= b.trade_date),
ka AS (SELECT instrument_id, trade_date, any_value(close) AS close, count(*) AS known, CASE WHEN count(*) >= 4 THEN sum(eps) FILTER (WHERE k <= 4) END AS ttm, CASE WHEN count(*) >= 8 THEN sum(eps) FILTER (WHERE k BETWEEN 5 AND 8) END AS before,
  trade_date - max(available) AS days_since, max(period_end) < date_trunc('quarter', trade_date) - INTERVAL 1 DAY AS pending FROM ks GROUP BY instrument_id, trade_date),
fu AS (SELECT bars.instrument_id, bars.trade_date, sector, coalesce(known, 0) AS known, ttm, before, CASE WHEN ttm > 0 AND bars.close > 0 THEN bars.close / ttm END AS pe, days_since, coalesce(pending, false) AS pending
  FROM bars JOIN sectors USING (instrument_id) LEFT JOIN ka ON ka.instrument_id = bars.instrument_id AND ka.trade_date = bars.trade_date),
fv AS (SELECT *, CASE WHEN pe IS NOT NULL AND sector IS NOT NULL AND count(pe) OVER s >= 3 THEN (count(pe) OVER s - (rank() OVER (PARTITION BY trade_date, sector ORDER BY pe NULLS LAST) - 1) - count(pe) OVER q + 0.5::DOUBLE * count(pe) OVER q) / count(pe) OVER s * 100 END AS value,
  CASE WHEN before > 0 THEN 50 + greatest(-1, least(1, (ttm - before) / before * 100 / 40)) * 50 WHEN before <= 0 AND ttm > 0 THEN 100 END AS growth FROM fu WINDOW s AS (PARTITION BY trade_date, sector), q AS (PARTITION BY trade_date, sector, pe)),
fs AS (SELECT *, coalesce({r("(coalesce(value * 0.6::DOUBLE, 0) + coalesce(growth * 0.4::DOUBLE, 0)) / nullif(CASE WHEN value IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN growth IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END, 0)", 2)}, 50) AS fundamental FROM fv)"""


def fundamentals(spark, sf) -> DataFrame:
    """instrument_id, trade_date, known, ttm, before, pe, days_since, pending, value, growth, fundamental of every bar. Line items and quarters are dealt by instrument, then bars find what was known where they lie."""
    # A task sorts its part three times over: parts are a quarter of the usual.
    n = 4 * deals(spark)
    bars = bars_daily(spark, sf, dealt=n)
    known = P.known_quarters(quarters(spark, sf), "instrument_id").repartition(n, "instrument_id")
    x = A.last_before(bars.select(*KEYS, "close"), known, "instrument_id", "trade_date", "usable_from", "state")
    state = F.col("state")
    x = x.select(*KEYS, F.coalesce(state["known"], F.lit(0)).cast("long").alias("known"), state["ttm"].alias("ttm"), state["before"].alias("before"), P.price_earnings(F.col("close"), state["ttm"]).alias("pe"),
                 F.datediff("trade_date", state["last_available"]).alias("days_since"), P.results_pending(F.col("trade_date"), state).alias("pending"))
    return P.fundamental(x.join(sectors(spark, sf), "instrument_id"))


@query(f"WITH {SQL_BARS}, {SQL_SECTORS}, {_FUND} SELECT instrument_id, trade_date, known, ttm, before, {r('pe')} AS pe, days_since, pending FROM fu")
def fundamentals_as_of(spark, sf) -> DataFrame:
    """What was known of earnings on each bar's day: two trailing years, price over earnings, how old the last result is, and whether one is due."""
    return fundamentals(spark, sf).select(*KEYS, "known", "ttm", "before", half_up(F.col("pe")).alias("pe"), "days_since", "pending")


@query(f"WITH {SQL_BARS}, {SQL_SECTORS}, {_FUND} SELECT instrument_id, trade_date, {r('value', 3)} AS value, {r('growth', 3)} AS growth, fundamental FROM fs")
def fundamental_scores(spark, sf) -> DataFrame:
    """Cheapness in the sector and growth, and the factor made of them."""
    return fundamentals(spark, sf).select(*KEYS, half_up(F.col("value"), 3).alias("value"), half_up(F.col("growth"), 3).alias("growth"), "fundamental")


# ---------------------------------------------------------------- sentiment of a name

# Origins of news that a tier of trust takes; None takes all.
ORIGIN_TIERS = {"live": ("LIVE_RSS", "LIVE_BSE"), "live+bse": ("LIVE_RSS", "LIVE_BSE", "BSE_BACKFILL"), "all": None}
_ORIGINS = ("LIVE_RSS", "LIVE_BSE", "BSE_BACKFILL", "GDELT")
# A document is news of two names on one of 300 days of 1997.
_NEWS = f"""nw AS (SELECT doc_id, [{", ".join(f"'{o}'" for o in _ORIGINS)}][1 + doc_id % 4] AS origin, unnest([1 + doc_id % m, 1 + (doc_id * 7) % m]) AS instrument_id, CAST(DATE '1997-01-01' + CAST((doc_id * 37) % 300 AS INTEGER) AS DATE) AS seen,
  CASE quality WHEN 1 THEN 0.5::DOUBLE ELSE -0.75::DOUBLE END AS score, (doc_id % 10) / 10.0::DOUBLE AS neutral FROM documents JOIN labels USING (doc_id), (SELECT max(l_suppkey) AS m FROM lineitem)),
sj AS (SELECT b.instrument_id, trade_date, trade_date - seen AS age, score, pow(0.5::DOUBLE, (trade_date - seen) / 7.0::DOUBLE) * (1 - neutral) AS w FROM bars b JOIN nw ON nw.instrument_id = b.instrument_id AND seen <= trade_date AND seen > trade_date - 30 WHERE origin <> 'GDELT'),
se AS (SELECT instrument_id, trade_date, count(*) AS articles, coalesce({r('CASE WHEN count(*) >= 3 AND sum(w) > 0 THEN 50 + 50 * sum(w * score) / sum(w) END', 2)}, 50) AS sentiment, min(age) AS newest FROM sj GROUP BY ALL)"""


def named_news(spark, sf, tier: str = "all") -> DataFrame:
    """A row for each name of each scored document of the tier."""
    one = table(spark, sf, "lineitem").agg(F.max("l_suppkey").alias("m"))  # one row
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").crossJoin(F.broadcast(one))
    i = F.col("doc_id")
    d = d.select("doc_id", F.element_at(F.array(*map(F.lit, _ORIGINS)), (1 + i % 4).cast("int")).alias("origin"), F.explode(F.array(1 + i % F.col("m"), 1 + (i * 7) % F.col("m"))).alias("instrument_id"),
                 F.date_add(F.lit("1997-01-01").cast("date"), ((i * 37) % 300).cast("int")).alias("seen"), F.when(F.col("quality") == 1, 0.5).otherwise(-0.75).alias("score"), ((i % 10) / 10).alias("neutral"))
    return d if ORIGIN_TIERS[tier] is None else d.where(F.col("origin").isin(*ORIGIN_TIERS[tier]))


def sentiments(spark, sf, bars: DataFrame) -> DataFrame:
    """instrument_id, trade_date, articles, sentiment, newest of bars with news in the 30 days up to them."""
    p = A.within_days(bars.select(*KEYS), named_news(spark, sf, "live+bse"), "instrument_id", "trade_date", "seen", 30)
    s = A.sentiment(p, list(KEYS), F.datediff("trade_date", "seen"), F.col("score"), F.col("neutral"))
    return s.select(*KEYS, "articles", half_up(F.col("score"), 2).alias("sentiment"), "newest")


@query(f"WITH {SQL_BARS}, {_NEWS} SELECT instrument_id, trade_date, articles, sentiment, newest FROM se")
def sentiment_scores(spark, sf) -> DataFrame:
    """The sentiment factor from news of the two trusted tiers; 50 with fewer than three articles."""
    return sentiments(spark, sf, bars_daily(spark, sf))


# ---------------------------------------------------------------- the stack

_TECH = "(trend * 0.35::DOUBLE + momentum * 0.3::DOUBLE + rs * 0.25::DOUBLE + srs * 0.25::DOUBLE) / (0.35::DOUBLE + 0.3 + 0.25 + 0.25)"
_STACK = f"""{_F}, {SQL_REGIME}, {_FUND}, {_NEWS},
pr AS (SELECT f.*, coalesce(rg.regime, 'SIDEWAYS') AS regime, {_TECH} AS technical, {r(_TECH, 2)} AS composite, fundamental, coalesce(sentiment, 50) AS sentiment, {r('rsi14', 2)} AS rsi, {r('macd - macd_signal', 2)} AS hist,
  {r('close', 2)} AS c, {r('ema20', 2)} AS e2, {r('ema50', 2)} AS e5, {r('ema200', 2)} AS e9 FROM f LEFT JOIN rg USING (trade_date) JOIN fs USING (instrument_id, trade_date) LEFT JOIN se ON se.instrument_id = f.instrument_id AND se.trade_date = f.trade_date),
pb AS (SELECT *, coalesce(lag(hist) OVER ({W}), hist) AS hist_before FROM pr),
pg AS (SELECT *, CASE WHEN regime = 'BULL' THEN 'bull-pullback:' || CASE WHEN NOT coalesce(e2 > e5 AND e5 > e9, false) THEN 'uptrend-stack' WHEN NOT coalesce(c > e5, false) THEN 'above-ema50'
    WHEN NOT coalesce((c - e2) / nullif(e2, 0) * 100 <= 2, false) THEN 'pullback-not-extended' WHEN NOT coalesce(rsi BETWEEN 40 AND 55, false) THEN 'pullback-rsi' WHEN NOT coalesce(hist > hist_before, false) THEN 'histogram-rising' END
  ELSE CASE WHEN regime = 'CRASH' THEN 'regime' WHEN NOT coalesce(composite >= 65 + CASE regime WHEN 'BEAR' THEN 10 WHEN 'HIGH_VOL' THEN 5 ELSE 0 END, false) THEN 'composite' WHEN NOT coalesce(technical >= 60, false) THEN 'technical-floor'
    WHEN NOT coalesce(hist > 0, false) THEN 'macd-bullish' WHEN NOT coalesce(c > e2, false) THEN 'price-above-ema20' WHEN NOT coalesce(rsi BETWEEN 35 AND 68, false) THEN 'rsi-band' WHEN fundamental < 50 THEN 'fundamental-floor' WHEN sentiment < 50 THEN 'sentiment-factor-floor' END END AS failed FROM pb)"""


def known_bars(spark, sf) -> DataFrame:
    """Daily bars with ttm and before (earnings known on the day) and sentiment, all found along an instrument's rows: line items, quarters and news are dealt by instrument, then nothing moves."""
    n = deals(spark)
    bars = bars_daily(spark, sf, dealt=n)
    held = P.known_quarters(quarters(spark, sf), "instrument_id").select("instrument_id", F.col("usable_from").alias("trade_date"), F.lit(0).alias("_side"), F.struct("state.ttm", "state.before").alias("_v")).repartition(n, "instrument_id")
    # A row a name and day, so that no frame of days holds more rows than days.
    news = named_news(spark, sf, "live+bse").select("instrument_id", F.col("seen").alias("trade_date"), "score", "neutral").repartition(n, "instrument_id")
    news = news.groupBy("instrument_id", "trade_date").agg(F.collect_list(F.struct(F.col("trade_date").alias("seen"), "score", "neutral")).alias("_news")).withColumn("_side", F.lit(0))
    u = bars.withColumn("_side", F.lit(1)).unionByName(held, allowMissingColumns=True).unionByName(news, allowMissingColumns=True)
    w = Window.partitionBy("instrument_id").orderBy("trade_date", "_side")
    u = u.withColumn("_lv", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.withColumn("_news", F.expr("collect_list(_news) OVER (PARTITION BY instrument_id ORDER BY trade_date RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)")).where("_side = 1")
    said = A.sentiment_of(F.flatten("_news"), lambda x: F.datediff("trade_date", x["seen"]), lambda x: x["score"], lambda x: x["neutral"])
    return u.select(*bars.columns, F.col("_lv.ttm").alias("ttm"), F.col("_lv.before").alias("before"), half_up(said, 2).alias("sentiment"))


def scored(spark, sf, ind: DataFrame, along=lambda x: x) -> DataFrame:
    """Every bar of ``ind`` with its factors, regime, fundamental and sentiment and composite. ``along``: what else is taken along an instrument's bars, pe with it or close and ttm left for it."""
    p = factor_panel(spark, sf, ind, lambda x: along(x.where("trade_date IS NOT NULL")))
    # A row a date.
    p = p.join(F.broadcast(regimes(spark, sf, ind).select("trade_date", "regime")), "trade_date", "left").withColumn("regime", F.coalesce("regime", F.lit("SIDEWAYS")))
    p = p if "pe" in p.columns else p.withColumn("pe", P.price_earnings(F.col("close"), F.col("ttm")))
    p = P.fundamental(p).withColumn("sentiment", F.coalesce("sentiment", F.lit(50.0)))
    return p.withColumn("technical", E.composite(P.PRODUCTION_WEIGHTS)).withColumn("composite", half_up(F.col("technical"), 2))


def stack(spark, sf, along=lambda x: x) -> DataFrame:
    """``scored`` with the first gate of the production stack that fails."""
    ind = with_indicators(spark, sf, known_bars(spark, sf))
    return scored(spark, sf, ind, lambda x: along(P.momentum_bars(x))).withColumn("failed", P.production_failure())


@query(f"{_STACK} SELECT instrument_id, trade_date, regime, composite, {r('greatest(0, least(1, 1 - list_aggregate([trend, momentum, rs, vol], ' + chr(39) + 'stddev_pop' + chr(39) + ') / 50))', 3)} AS agreement, failed FROM pg WHERE ema200 IS NOT NULL")
def production_gates(spark, sf) -> DataFrame:
    """The production stack's decision on every bar: in a BULL regime the pullback's gates stand instead of all others."""
    p = stack(spark, sf).where("ema200 IS NOT NULL")
    return p.select(*KEYS, "regime", "composite", half_up(E.agreement(list(P.AGREEING)), 3).alias("agreement"), "failed")


@query(f"""{_STACK} SELECT instrument_id, trade_date, {r('''(technical * w[1] + CASE WHEN sentiment <> 50 THEN sentiment * w[2] ELSE 0 END + fundamental * w[3]) / (w[1] + CASE WHEN sentiment <> 50 THEN w[2] ELSE 0 END + w[3])''', 2)} AS blended
FROM (SELECT *, CASE regime WHEN 'BULL' THEN [0.5::DOUBLE, 0.3, 0.2] WHEN 'HIGH_VOL' THEN [0.4::DOUBLE, 0.45, 0.15] WHEN 'BEAR' THEN [0.3::DOUBLE, 0.3, 0.4] ELSE [0.35::DOUBLE, 0.25, 0.4] END AS w FROM pg) WHERE ema200 IS NOT NULL""")
def blended_composite(spark, sf) -> DataFrame:
    """The composite with all buckets in use, weighed by regime; a name without a lean of the news has no sentiment bucket."""
    p = stack(spark, sf).where("ema200 IS NOT NULL")
    lean = F.when(F.col("sentiment") != 50, F.col("sentiment"))
    return p.select(*KEYS, half_up(P.blend(F.col("regime"), F.col("technical"), lean, F.col("fundamental")), 2).alias("blended"))


# Suppliers trade on one day in five, so continuity is a fifth of that of a listed name: the least quality is set to match.
LEAST_QUALITY = 0.15
# Their prices move by tens of per cent a day, where those of a listed name move by one or two: the bounds of volatility and stop are ten times the usual.
WILD, LOSS_BAND = 60.0, (0.5, 100.0)
_SIGNALS = f"""{_STACK}, dq AS (SELECT instrument_id, trade_date, row_number() OVER ({W}) AS n, min(trade_date) OVER ({W}) AS d0, sum(CASE WHEN low > 0 AND volume >= 0 AND high >= low THEN 0 ELSE 1 END) OVER ({W}) AS bad, min(low) OVER ({W} ROWS 14 PRECEDING) AS low15 FROM bars),
dz AS (SELECT *, trade_date - d0 + 1 AS span, isodow(d0) - 1 AS wd FROM dq),
dy AS (SELECT *, span // 7 * 5 + span % 7 - greatest(0, least(wd + span % 7, 7) - greatest(wd, 5)) - greatest(0, wd + span % 7 - 12) AS days FROM dz),
sl AS (SELECT pg.*, greatest(close - CASE WHEN atr14 / close * 100 < 1.5 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END * atr14, low15 * 0.997::DOUBLE) AS stop, atr14 / close * 100 AS atr_pct FROM pg JOIN dy ON dy.instrument_id = pg.instrument_id AND dy.trade_date = pg.trade_date
  WHERE failed IS NULL AND ema200 IS NOT NULL AND {r('least(1.0::DOUBLE, n / greatest(1.0::DOUBLE, days * 0.94::DOUBLE)) * (1 - bad / n::DOUBLE) * CASE WHEN n < 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END')} >= {LEAST_QUALITY}),
ok AS (SELECT * FROM sl WHERE atr_pct < {WILD} AND (close - stop) / close * 100 BETWEEN {LOSS_BAND[0]} AND {LOSS_BAND[1]}),
co AS (SELECT instrument_id, min(trade_date) AS trade_date FROM ok GROUP BY instrument_id UNION ALL
  SELECT * FROM (SELECT co.instrument_id, (SELECT min(ok.trade_date) FROM ok WHERE ok.instrument_id = co.instrument_id AND ok.trade_date >= co.trade_date + 5) AS trade_date FROM co) WHERE trade_date IS NOT NULL),
sg2 AS (SELECT ok.instrument_id, ok.trade_date, sector, regime, composite, close AS entry, stop, close + 2 * (close - stop) AS target1, atr_pct FROM ok JOIN co ON co.instrument_id = ok.instrument_id AND co.trade_date = ok.trade_date)"""


def signal_readings(spark, sf) -> DataFrame:
    """Bars as a table dealt by instrument, with what ``signals`` reads of them: averages, ATR and factors only of bars (``may``) whose own readings a gate does not stop already."""
    x = S.indicators(known_bars(spark, sf).drop("open"))
    x = x.withColumns({"rsi": half_up(F.col("rsi14"), 2), "hist": half_up(F.col("macd") - F.col("macd_signal"), 2)})
    sound = (F.col("low") > 0) & (F.col("volume") >= 0) & (F.col("high") >= F.col("low"))
    may = F.col("ema200").isNotNull() & F.coalesce(F.try_divide("atr14", "close") * 100 < WILD, F.lit(False)) & P.may_pass()
    x = x.withColumns({"may": may, "unsound": sound.cast("int") * -1 + 1, "over_ema50": E.over_ema50()})
    own = {c: F.col(c) for c in ("ema20", "ema50", "ema200", "atr14", "rsi")} | bar_factors()
    x = x.select(*KEYS, "close", "low", "volume", "ttm", "before", "sentiment", "hist", "may", "unsound", "over_ema50", *(F.when(F.col("may"), c).alias(k) for k, c in own.items()))
    return dealt(x, "signal-readings", "instrument_id")


def signals(spark, sf, more: tuple = ()) -> DataFrame:
    """Raw signals: all gates, quality of the history as of the day, levels, then no second one within five days of an accepted one. ``more``: further columns, net (what the next five bars earn) among them."""
    run = S.by().rowsBetween(Window.unboundedPreceding, 0)
    n, d0, bad = F.row_number().over(S.by()), F.min("trade_date").over(run), F.sum("unsound").over(run)

    def along(x: DataFrame) -> DataFrame:
        x = P.momentum_bars(x).withColumn("n", n).withColumn("d0", d0).withColumn("bad", bad).withColumn("low15", F.min("low").over(S.last(15))).withColumn("net", half_up(S.forward_return(5), 2))
        x = x.withColumn("quality", half_up(S.quality(F.col("n"), F.col("d0"), F.col("trade_date"), F.col("bad"))))
        lv = E.levels(F.col("low15"), WILD, LOSS_BAND)
        x = x.withColumns({"stop": lv["stop"], "target1": lv["target1"], "atr_pct": F.col("atr14") / F.col("close") * 100, "pe": P.price_earnings(F.col("close"), F.col("ttm")), "growth": P.growth(F.col("ttm"), F.col("before"))})
        x = x.withColumn("may", F.col("may") & F.coalesce(F.col("quality") >= LEAST_QUALITY, F.lit(False)) & lv["reject"].isNull())
        # Other bars are but peers, by r60 and pe: nothing else of them goes to their date, and none that has neither.
        x = x.where("may OR r60 IS NOT NULL OR pe IS NOT NULL")
        own = ("close", "ema20", "ema50", "ema200", "rsi", "hist", "hist_before", "trend", "momentum", "rs", "vol", "calm", "growth", "sentiment", "net", "stop", "target1", "atr_pct")
        return x.withColumns({c: F.when(F.col("may"), F.col(c)) for c in own})

    p = scored(spark, sf, signal_readings(spark, sf), along)
    ok = p.where(F.col("may") & P.production_failure().isNull())
    # Written: what passes is a small part of the bars.
    ok = written(ok.select(*KEYS, "sector", "regime", "composite", F.col("close").alias("entry"), "stop", "target1", "atr_pct", *more), "passed")
    return P.cooled(ok, "instrument_id", "trade_date")


@query(f"{_SIGNALS} SELECT instrument_id, trade_date, sector, regime, composite, {r('entry', 3)} AS entry, {r('stop', 3)} AS stop, {r('target1', 3)} AS target1 FROM sg2")
def raw_signals(spark, sf) -> DataFrame:
    return signals(spark, sf).select(*KEYS, "sector", "regime", "composite", *(half_up(F.col(c), 3).alias(c) for c in ("entry", "stop", "target1")))


_ALLOCATED = f"""{_SIGNALS}, az AS (SELECT *, CASE WHEN entry > stop THEN least(floor(2000 / (entry - stop)), floor(100000 / entry)) ELSE 0 END AS q0 FROM sg2),
aq AS (SELECT *, CAST(CASE WHEN atr_pct >= 3 AND atr_pct < 6 THEN floor(q0 * 0.75::DOUBLE) ELSE q0 END AS BIGINT) AS qty FROM az),
ax AS (SELECT *, CASE WHEN qty < 1 THEN 'sizing' WHEN qty * (target1 - entry) < 3 * {r('qty * entry', 2)} * 0.25::DOUBLE / 100 THEN 'cost-drag' END AS v FROM aq),
ay AS (SELECT *, v IS NULL AND (sector IS NULL OR sum((v IS NULL)::INT) OVER (PARTITION BY trade_date, sector ORDER BY composite DESC, instrument_id ROWS UNBOUNDED PRECEDING) <= 1) AS fits FROM ax),
aw AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY trade_date ORDER BY composite DESC, instrument_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4 FROM ay)"""


@query(f"""{_ALLOCATED}
SELECT instrument_id, trade_date, qty, CASE WHEN v IS NOT NULL THEN v WHEN b4 >= 2 THEN 'position-limit' WHEN NOT fits THEN 'sector-cap' END AS verdict FROM aw""")
def allocated_signals(spark, sf) -> DataFrame:
    """Size and verdict of each raw signal against the others of its day."""
    return P.allocate(signals(spark, sf), "trade_date", "composite", "instrument_id").select(*KEYS, "qty", "verdict")


@query(f"{_STACK}, g AS (SELECT failed, count(*) AS n FROM pg WHERE ema200 IS NOT NULL AND failed IS NOT NULL GROUP BY failed) SELECT failed, n FROM g ORDER BY n DESC, failed LIMIT 4")
def top_rejections(spark, sf) -> DataFrame:
    """The four gates that stop most."""
    return stack(spark, sf).where("ema200 IS NOT NULL AND failed IS NOT NULL").groupBy("failed").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "failed").limit(4)


@query(f"""{_STACK}, rk AS (SELECT instrument_id, trade_date, composite, row_number() OVER (PARTITION BY trade_date ORDER BY composite DESC, instrument_id) AS place FROM pg WHERE ema200 IS NOT NULL AND failed IS NULL) SELECT * FROM rk WHERE place <= 5""")
def ranked_candidates(spark, sf) -> DataFrame:
    """The best five of each day among those that pass."""
    p = stack(spark, sf).where("ema200 IS NOT NULL AND failed IS NULL").select(*KEYS, "composite")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("composite"), "instrument_id"))).where("place <= 5")


@query(f"""{_F}, {SQL_REGIME}, t AS (SELECT instrument_id, trade_date, {r(f'(lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100', 2)} AS net FROM bars WHERE close > 0)
SELECT regime, count(*) AS n, {r('count(*) FILTER (WHERE net > 0) / count(*)::DOUBLE * 100', 2)} AS win_rate, {r('avg(net)', 2)} AS expectancy FROM t JOIN rg USING (trade_date) WHERE net IS NOT NULL GROUP BY regime""")
def regime_metrics(spark, sf) -> DataFrame:
    """What 5-bar trades earn, by the regime of the day they are decided on."""
    ind = with_indicators(spark, sf)
    t = bars_of(ind).where("close > 0").select(*KEYS, half_up(S.forward_return(5), 2).alias("net")).where("net IS NOT NULL").join(F.broadcast(regimes(spark, sf, ind).select("trade_date", "regime")), "trade_date")
    m = t.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("w"), F.avg("net").alias("e"))
    return m.select("regime", "n", half_up(F.col("w") * 100, 2).alias("win_rate"), half_up(F.col("e"), 2).alias("expectancy"))


_SUBJECTS = ("trend", "momentum", "rs", "srs", "vol", "calm")


@query(f"""{_F}, lb AS (SELECT instrument_id, trade_date, (lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100 AS fwd FROM bars),
lg AS ({" UNION ALL ".join(f"SELECT '{s}' AS subject, f.instrument_id, f.trade_date, {r(s, 3)} AS score, fwd FROM f JOIN lb ON lb.instrument_id = f.instrument_id AND lb.trade_date = f.trade_date WHERE fwd IS NOT NULL AND ema200 IS NOT NULL" for s in _SUBJECTS)}),
rk AS (SELECT subject, trade_date, rank() OVER (PARTITION BY subject, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY subject, trade_date, score) - 1) / 2 AS x, rank() OVER (PARTITION BY subject, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY subject, trade_date, fwd) - 1) / 2 AS y FROM lg),
su AS (SELECT subject, trade_date, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM rk GROUP BY ALL HAVING count(*) >= 5),
ic AS (SELECT subject, trade_date, floor(CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0 END * 1e3 + 0.5) / 1e3 AS ic FROM su)
SELECT subject, coalesce(regime, 'ALL') AS regime, count(*) AS days, {r('avg(ic)', 3)} AS mean FROM (SELECT subject, trade_date, ic, rg.regime FROM ic JOIN rgx rg USING (trade_date)) GROUP BY GROUPING SETS ((subject), (subject, regime))""".replace("lg AS (", SQL_REGIME + ", rgx AS (SELECT trade_date, regime FROM rg), lg AS (", 1))
def conditioning(spark, sf) -> DataFrame:
    """Daily rank correlation of each factor with the next five bars, over all days and by regime; all subjects in one pass."""
    ind = with_indicators(spark, sf)
    p = factor_panel(spark, sf, ind, lambda x: x.withColumn("fwd", S.forward_return(5))).where("fwd IS NOT NULL AND ema200 IS NOT NULL AND trade_date IS NOT NULL").select(*KEYS, "fwd", *(half_up(F.col(s), 3).alias(s) for s in _SUBJECTS))
    ic = G.rank_sums(p, _SUBJECTS, {("fwd", 5): "fwd"}, "trade_date", "instrument_id", 5).select("subject", "trade_date", X.rank_correlation().alias("ic"))
    ic = ic.join(F.broadcast(regimes(spark, sf, ind).select("trade_date", "regime")), "trade_date")
    both = ic.select("subject", "ic", F.explode(F.array("regime", F.lit("ALL"))).alias("regime"))
    return both.groupBy("subject", "regime").agg(F.count(F.lit(1)).alias("days"), half_up(F.avg("ic"), 3).alias("mean"))
