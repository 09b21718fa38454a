"""The measurement grid, residuals on beta, ranks inside sectors; calendars, filters and stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, percent_change
from ..operators import cross as X
from ..operators import factors as E
from ..operators import grid as G
from ..operators import series as S
from ..operators import strategy as P
from ..operators import titles
from ..sources.market import SQL_BARS, SQL_BENCH, SQL_SECTORS, bars_daily, benchmark, sectors, table
from ..sources.shared import dealt, deals
from .cross_queries import _F, bar_factors
from .registry import query, r
from .series_queries import _H, _SQL_LABELS, KEYS, SQL_INDICATORS, W
from .strategy_queries import _STACK, _SUBJECTS, known_bars, scored

LEAST, LEAST_DECILES = 10, 20
_NINE = (*_SUBJECTS, "fundamental", "sentiment", "composite")
_SCORES = {s: r(f"pg.{s}", 3) if s in _SUBJECTS else f"pg.{s}" for s in _NINE}
_CELLS = f"""{_STACK}, {_SQL_LABELS},
rt AS (SELECT instrument_id, b.trade_date, close / nullif(lag(close) OVER w, 0) - 1 AS r, bench / nullif(lag(bench) OVER w, 0) - 1 AS b FROM bars b JOIN benchmark_days USING (trade_date) WINDOW w AS (PARTITION BY instrument_id ORDER BY b.trade_date)),
bt AS (SELECT instrument_id, trade_date, count(*) OVER w AS n, {r('covar_pop(r, b) OVER w / nullif(var_pop(b) OVER w, 0)')} AS b FROM rt WHERE r IS NOT NULL AND b IS NOT NULL WINDOW w AS ({W} ROWS 251 PRECEDING)),
la AS (SELECT instrument_id, trade_date, ln(median(CASE WHEN close * volume > 0 THEN close * volume END) OVER ({W} ROWS 19 PRECEDING)) AS a FROM bars),
cx AS (SELECT pg.instrument_id, pg.trade_date, pg.sector, pg.regime, {", ".join(f"{v} AS {k}" for k, v in _SCORES.items())}, la.a, CASE WHEN bt.n >= 20 THEN bt.b END AS b, h, fwd, mkt FROM pg JOIN labels l ON l.instrument_id = pg.instrument_id AND l.trade_date = pg.trade_date
  LEFT JOIN la ON la.instrument_id = pg.instrument_id AND la.trade_date = pg.trade_date LEFT JOIN bt ON bt.instrument_id = pg.instrument_id AND bt.trade_date = pg.trade_date WHERE ema200 IS NOT NULL AND fwd IS NOT NULL),
cc AS (SELECT *, fwd - avg(fwd) OVER s AS cy, a - avg(a) OVER s AS ca, b - avg(b) OVER s AS cb FROM cx WHERE a IS NOT NULL AND b IS NOT NULL WINDOW s AS (PARTITION BY trade_date, h, sector)),
ct AS (SELECT trade_date, h, count(*) AS n, count(DISTINCT sector) + 2 AS p, sum(ca * ca) AS aa, sum(ca * cb) AS ab, sum(cb * cb) AS bb, sum(ca * cy) AS ay, sum(cb * cy) AS bq FROM cc GROUP BY ALL),
cl AS (SELECT cx.*, 'raw' AS label, {r('fwd')} AS y FROM cx UNION ALL SELECT cx.*, 'excess', {r('fwd - mkt')} FROM cx WHERE mkt IS NOT NULL
  UNION ALL SELECT cc.* EXCLUDE (cy, ca, cb), 'residual', {r('cy - (ay * bb - bq * ab) / (aa * bb - ab * ab) * ca - (bq * aa - ay * ab) / (aa * bb - ab * ab) * cb', 2)} FROM cc JOIN ct USING (trade_date, h) WHERE n >= 20 AND n > p AND aa * bb - ab * ab > 1e-12),
gr AS (SELECT instrument_id, trade_date, regime, label, h, a, y, unnest([{", ".join(f"'{s}'" for s in _NINE)}]) AS subject, unnest([{", ".join(f"CAST({s} AS DOUBLE)" for s in _NINE)}]) AS score FROM cl)"""
_GRID = f"""{_CELLS},
rk AS (SELECT subject, label, h, trade_date, regime, rank() OVER (PARTITION BY subject, label, h, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY subject, label, h, trade_date, score) - 1) / 2 AS x, rank() OVER (PARTITION BY subject, label, h, trade_date ORDER BY y) + (count(*) OVER (PARTITION BY subject, label, h, trade_date, y) - 1) / 2 AS y FROM gr WHERE score IS NOT NULL),
su AS (SELECT subject, label, h, trade_date, any_value(regime) AS regime, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM rk GROUP BY subject, label, h, trade_date HAVING count(*) >= {LEAST}),
ic AS (SELECT subject, label, h, trade_date, floor(CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0 END * 1e3 + 0.5) AS ic, unnest(['ALL', regime]) AS regime FROM su),
d AS (SELECT *, row_number() OVER c AS i, ic - avg(ic) OVER (PARTITION BY subject, label, h, regime) AS e FROM ic WHERE regime <> 'CRASH' WINDOW c AS (PARTITION BY subject, label, h, regime ORDER BY trade_date)),
s AS (SELECT subject, label, h, regime, count(*) AS days, avg(ic) AS mean, stddev_samp(ic) AS sd, sum(e * e) AS s0 FROM d GROUP BY ALL),
ge AS (SELECT subject, label, h, regime, list(e ORDER BY i) AS v FROM d GROUP BY ALL),
gl AS (SELECT subject, label, h, regime, list_sum([2 * (1 - l / (h + 1)) * list_sum([v[i] * v[i + l] FOR i IN range(1, len(v) - l + 1)]) FOR l IN range(1, least(h, len(v) - 1) + 1)]) AS sl FROM ge)
SELECT subject, label, h, regime, days, {r('mean / 1000')} AS mean, {r('sd / 1000', 3)} AS sd, {r('mean / nullif(sd, 0)', 3)} AS ir, {r('mean / nullif(sd, 0) * sqrt(days)', 2)} AS t,
  {r('CASE WHEN s0 + coalesce(sl, 0) > 1e-12 THEN mean / sqrt((s0 + coalesce(sl, 0)) / days / days) ELSE 0 END', 2)} AS nw_t, CASE WHEN regime = 'ALL' THEN mean >= 20 AND CASE WHEN s0 + coalesce(sl, 0) > 1e-12 THEN mean / sqrt((s0 + coalesce(sl, 0)) / days / days) ELSE 0 END >= 3 END AS clears
FROM s JOIN gl USING (subject, label, h, regime)"""


_LABELS = {("raw", h): f"fwd{h}" for h in _H} | {("excess", h): f"excess{h}" for h in _H}


# What goes to its date as a whole number, as it is rounded anyway: by what it is multiplied.
_WHOLE = {c: 10000 for c in ("b", *_LABELS.values()) if not c.startswith("fwd")} | {"vol": 1000, "calm": 1000}


def readings(spark, sf) -> DataFrame:
    """Bars as a table dealt by instrument, with no more than ``cells`` reads of them: prices but the close, and indicators, go no further than the factors that they make."""
    x = S.indicators(known_bars(spark, sf).drop("open"))
    x = x.select(*KEYS, "close", "volume", "ttm", "before", "sentiment", *(c.alias(k) for k, c in bar_factors().items()), E.over_ema50().alias("over_ema50"), F.col("ema200").isNotNull().alias("measured"))
    return dealt(x, "readings", "instrument_id")


def cells(spark, sf) -> DataFrame:
    """What is measured: a row a name and date with the subjects (eight factors and the composite), raw and excess labels of every horizon, and what the residual one is found from. All of it is taken along a name's bars, then dealt by date once."""
    bars = readings(spark, sf)

    def along(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(benchmark(bars)), "trade_date", "left")
        # All that is read ahead is one window.
        ahead = (F.lead(c, k).over(S.by()).alias(f"_{c}{k}") for c in ("close", "bench") for k in (1, *(1 + h for h in _H)))
        x = x.select("*", S.log_adv().alias("a"), *ahead)
        change = lambda c, h: percent_change(F.col(f"_{c}{1 + h}"), F.col(f"_{c}1"))
        x = x.withColumns({f"fwd{h}": change("close", h) for h in _H} | {f"excess{h}": change("close", h) - change("bench", h) for h in _H})
        x = x.withColumns({"pe": P.price_earnings(F.col("close"), F.col("ttm")), "growth": P.growth(F.col("ttm"), F.col("before"))})
        x = S.with_beta(x).withColumn("b", F.col("beta"))
        # Bars without an EMA 200 are but peers of others, by r60 and pe: nothing else of them goes to their date, and none that has neither.
        x = x.where("measured OR r60 IS NOT NULL OR pe IS NOT NULL")
        own = ("trend", "momentum", "rs", "vol", "calm", "growth", "sentiment", "a", "b", *_LABELS.values())
        return x.withColumns({c: F.when(F.col("measured"), F.floor(F.col(c) * _WHOLE[c] + 0.5) if c in _WHOLE else F.col(c)) for c in own})

    p = scored(spark, sf, bars, along).where("measured")
    p = p.withColumns({c: F.col(c).cast("double") / k for c, k in _WHOLE.items()})
    scores = (half_up(F.col(s), 3).alias(s) if s in _SUBJECTS and s not in _WHOLE else F.col(s).cast("double").alias(s) for s in _NINE)
    return p.select(*KEYS, "sector", "regime", *scores, "a", "b", *_LABELS.values())


@query(_GRID)
def measurement_grid(spark, sf) -> DataFrame:
    """Daily rank correlation of nine subjects with three labels over six horizons, over all days and by regime, with Newey-West's t at h lags and whether a cell clears the bar: all cells are rows of one pass."""
    ic = G.rank_sums(cells(spark, sf), _NINE, _LABELS, "trade_date", "instrument_id", LEAST, ["regime"], ("a", "b", "sector")).withColumn("ic", X.rank_correlation())
    both = ic.select("subject", "label", "h", "trade_date", F.floor(F.col("ic") * 1000 + 0.5).cast("double").alias("ic"), F.explode(F.array("regime", F.lit("ALL"))).alias("regime")).where("regime <> 'CRASH'")
    # Correlations have three places: as whole thousandths their sums are exact in any order.
    s = X.series_summary(both, "ic", "trade_date", ["subject", "label", "h", "regime"], lags="h")
    bar = F.when(F.col("regime") == "ALL", (F.col("mean") >= 20) & (F.col("nw_t") >= 3))
    return s.select("subject", "label", "h", "regime", F.col("t_obs").alias("days"), half_up(F.col("mean") / 1000).alias("mean"), half_up(F.col("sd") / 1000, 3).alias("sd"), half_up(F.col("ir"), 3).alias("ir"), *(half_up(F.col(c), 2).alias(c) for c in ("t", "nw_t")), bar.alias("clears"))


@query(f"""{_CELLS}, de AS (SELECT *, floor((row_number() OVER w - 1) * 10 / count(*) OVER c) AS decile, count(*) OVER c AS names FROM gr WHERE score IS NOT NULL
  WINDOW w AS (PARTITION BY subject, label, h, trade_date ORDER BY score, instrument_id), c AS (PARTITION BY subject, label, h, trade_date)),
dx AS (SELECT subject, label, h, unnest(['ALL', regime]) AS regime, CAST(decile AS BIGINT) AS decile, y, a FROM de WHERE names >= {LEAST_DECILES})
SELECT subject, label, h, regime, decile, count(*) AS n, {r('CAST(sum(CAST(floor(y * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000', 2)} AS mean, {r('sum(exp(a) * y) / sum(exp(a))', 2)} AS weighted FROM dx WHERE regime <> 'CRASH' GROUP BY ALL""")
def measurement_deciles(spark, sf) -> DataFrame:
    """What each tenth of a subject's names is followed by, per cell of the grid: means of names, and by turnover."""
    x = G.bucket_sums(cells(spark, sf), _NINE, _LABELS, "trade_date", "instrument_id", LEAST_DECILES, "a", ["regime"], ("a", "b", "sector"))
    x = x.withColumn("regime", F.explode(F.array("regime", F.lit("ALL")))).where("regime <> 'CRASH'")
    g = x.groupBy("subject", "label", "h", "regime", "decile").agg(F.sum("n").alias("n"), half_up(F.sum("k").cast("double") / F.sum("n") / 10000, 2).alias("mean"), half_up(F.try_divide(F.sum("wy"), F.sum("w")), 2).alias("weighted"))
    return g


@query(f"""WITH {SQL_BARS}, {SQL_BENCH}, {SQL_SECTORS}, {_SQL_LABELS},
rt AS (SELECT instrument_id, b.trade_date, close / nullif(lag(close) OVER w, 0) - 1 AS r, bench / nullif(lag(bench) OVER w, 0) - 1 AS b FROM bars b JOIN benchmark_days USING (trade_date) WINDOW w AS (PARTITION BY instrument_id ORDER BY b.trade_date)),
bt AS (SELECT instrument_id, trade_date, count(*) OVER w AS n, {r('covar_pop(r, b) OVER w / nullif(var_pop(b) OVER w, 0)')} AS b FROM rt WHERE r IS NOT NULL AND b IS NOT NULL WINDOW w AS ({W} ROWS 251 PRECEDING)),
a AS (SELECT instrument_id, trade_date, ln(median(CASE WHEN close * volume > 0 THEN close * volume END) OVER ({W} ROWS 19 PRECEDING)) AS a FROM bars),
j AS (SELECT instrument_id, l.trade_date, sector, fwd AS y, a, b FROM labels l JOIN a USING (instrument_id, trade_date) JOIN bt USING (instrument_id, trade_date) JOIN sectors USING (instrument_id) WHERE h = 5 AND fwd IS NOT NULL AND a IS NOT NULL AND n >= 20 AND b IS NOT NULL),
c AS (SELECT *, y - avg(y) OVER s AS cy, a - avg(a) OVER s AS ca, b - avg(b) OVER s AS cb FROM j WINDOW s AS (PARTITION BY trade_date, sector)),
t AS (SELECT trade_date, count(*) AS n, count(DISTINCT sector) + 2 AS k, sum(ca * ca) AS aa, sum(ca * cb) AS ab, sum(cb * cb) AS bb, sum(ca * cy) AS ay, sum(cb * cy) AS bq FROM c GROUP BY trade_date)
SELECT instrument_id, trade_date, {r('cy - (ay * bb - bq * ab) / (aa * bb - ab * ab) * ca - (bq * aa - ay * ab) / (aa * bb - ab * ab) * cb', 2)} AS residual FROM c JOIN t USING (trade_date) WHERE n >= 20 AND n > k AND aa * bb - ab * ab > 1e-12""")
def residuals_on_beta(spark, sf) -> DataFrame:
    """5-bar labels less what size, beta and sector explain on each date."""
    bars = bars_daily(spark, sf)
    x = bars.join(F.broadcast(benchmark(bars)), "trade_date").withColumn("fwd", S.forward_return(5)).withColumn("a", S.log_adv())
    j = S.with_beta(x).where("fwd IS NOT NULL").withColumn("b", half_up(F.col("beta"))).join(sectors(spark, sf), "instrument_id").select(*KEYS, "sector", "fwd", "a", "b")
    return X.residuals(j, "fwd", ("a", "b"), "sector", "trade_date").where("residual IS NOT NULL").select(*KEYS, half_up(F.col("residual"), 2).alias("residual"))


@query(f"""WITH {SQL_BARS}, {SQL_SECTORS}, x AS (SELECT instrument_id, trade_date, sector, CASE WHEN lag(close, 60) OVER ({W}) > 0 THEN (close - lag(close, 60) OVER ({W})) / lag(close, 60) OVER ({W}) * 100 END AS r60 FROM bars JOIN sectors USING (instrument_id))
SELECT instrument_id, trade_date, count(r60) OVER s AS peers, {r('median(r60) OVER s', 3)} AS median, rank() OVER (PARTITION BY trade_date, sector ORDER BY r60 DESC) AS place FROM x WHERE r60 IS NOT NULL WINDOW s AS (PARTITION BY trade_date, sector)""")
def sector_ranks(spark, sf) -> DataFrame:
    """Place of a name in its sector by 60-day return, with the sector's median; a date's sector is as large as its names."""
    x = bars_daily(spark, sf).join(sectors(spark, sf), "instrument_id").withColumn("r60", S.lookback_return(60)).where("r60 IS NOT NULL")
    s = Window.partitionBy("trade_date", "sector")
    return x.select(*KEYS, F.count("r60").over(s).alias("peers"), half_up(F.percentile("r60", F.lit(0.5)).over(s), 3).alias("median"), F.rank().over(s.orderBy(F.desc("r60"))).alias("place"))


@query(f"""WITH {SQL_INDICATORS}, a AS (SELECT instrument_id, trade_date, {r('atr14 / close * 100')} AS p FROM ind WHERE close > 0), l AS (SELECT instrument_id, trade_date, p, list(p) OVER ({W} ROWS 99 PRECEDING) AS all_ FROM a),
c AS (SELECT *, list_filter(all_, lambda x: x IS NOT NULL) AS v FROM l)
SELECT instrument_id, trade_date, {r('(len(list_filter(v, lambda x: x < p)) + 0.5::DOUBLE * len(list_filter(v, lambda x: x = p))) / len(v) * 100', 3)} AS percentile FROM c WHERE p IS NOT NULL""")
def atr_percentiles(spark, sf) -> DataFrame:
    """Mid-rank of a bar's ATR share among the last hundred bars of its name."""
    x = S.atr_percentiles(bars_daily(spark, sf, dealt=deals(spark)).select(*KEYS, "close", "high", "low"))
    return x.select(*KEYS, half_up(F.col("percentile"), 3).alias("percentile")).where("percentile IS NOT NULL")


@query("""WITH d AS (SELECT CAST(unnest(range((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem), (SELECT max(CAST(l_shipdate AS DATE)) + 1 FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, strftime(day, '%d%m%Y') AS token, NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_shipdate AS DATE) = day) AS absent FROM d WHERE isodow(day) < 6""")
def archive_days(spark, sf) -> DataFrame:
    """Weekdays of the history, the name of each one's file in the archive, and which have none."""
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    d = li.agg(F.sequence(F.min("day"), F.max("day")).alias("d")).select(F.explode("d").alias("day")).where(F.weekday("day") < 5)  # one row becomes a row a day
    have = li.distinct().withColumn("have", F.lit(True))
    return d.join(have, "day", "left").select("day", F.date_format("day", "ddMMyyyy").alias("token"), F.col("have").isNull().alias("absent"))


@query("""WITH l AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events), w AS (SELECT CAST(unnest(range(a, z + 1, INTERVAL 7 DAY)) AS DATE) AS start, z FROM l)
SELECT start, CAST(least(start + 6, z) AS DATE) AS until, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN start AND least(start + 6, z)) AS n FROM w""")
def query_windows(spark, sf) -> DataFrame:
    """Abutting windows of a week over the events, and how many each has."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    w = e.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("start"), "a", "z")  # a row a window
    w = w.select("start", F.least(F.date_add("start", 6), "z").alias("until"), F.floor(F.datediff("start", "a") / 7).alias("k"))
    first = e.agg(F.min("day").alias("a"))
    n = e.crossJoin(F.broadcast(first)).groupBy(F.floor(F.datediff("day", "a") / 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, "k", "left").select("start", "until", F.coalesce("n", F.lit(0)).alias("n"))


_NAMES = (("TH", "thened", None), ("ON", "of the on", None), ("DER", "der die", "der"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND regexp_matches(lower(text), '(^|[^a-z0-9])(" + "|".join(p.replace(" ", r"\s+") for _, p, _ in _NAMES) + ")($|[^a-z0-9])')")
def relevant_records(spark, sf) -> DataFrame:
    """English records whose whole text names any alias: one alternation, before anything else is done with them."""
    d = table(spark, sf, "documents").where("lang = 'en'")
    return d.where(titles.names_any(F.col("text"), [p for _, p, _ in _NAMES])).select("doc_id", "lang")


@query(f"SELECT s_name AS name, max(ts) AS ts, {r('arg_max(value, (ts, event_id))', 2)} AS value FROM events JOIN supplier ON s_suppkey = user_id WHERE s_nationkey % 5 = 0 GROUP BY s_name")
def index_ticks(spark, sf) -> DataFrame:
    """Last value of the instruments that are indices, by name."""
    i = table(spark, sf, "supplier").where("s_nationkey % 5 = 0").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    return table(spark, sf, "events").join(i, "user_id").groupBy("name").agg(F.max("ts").alias("ts"), half_up(F.max_by("value", F.struct("ts", "event_id")), 2).alias("value"))


@query("SELECT event_type AS kind, count(*) AS n, max(ts) AS newest, left(sha256(event_type || ':' || count(*) || ':' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')), 12) AS version FROM events GROUP BY event_type")
def data_versions(spark, sf) -> DataFrame:
    """A stamp for what a run has read: counts and newest rows by kind."""
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
    return g.withColumn("version", F.substring(F.sha2(F.concat_ws(":", "kind", F.col("n").cast("string"), F.date_format("newest", "yyyy-MM-dd HH:mm:ss")), 256), 1, 12))


@query(f"""{_F} SELECT instrument_id, trade_date, CASE WHEN close > ema20 AND ema20 > ema50 AND ema50 > ema200 THEN 'Bullish stack: ' WHEN close < ema20 AND ema20 < ema50 AND ema50 < ema200 THEN 'Bearish stack: ' WHEN close > ema20 THEN 'Over EMA20: ' ELSE 'Under EMA20: ' END
  || printf('price %.2f, EMA20 %.2f', {r('close', 2)}, {r('ema20', 2)}) AS why FROM f WHERE ema200 IS NOT NULL""")
def trend_explained(spark, sf) -> DataFrame:
    """What the trend factor says of a bar, in words."""
    p = S.indicators(bars_daily(spark, sf)).where("ema200 IS NOT NULL")
    c, a, b, z = (F.col(x) for x in ("close", "ema20", "ema50", "ema200"))
    head = F.when((c > a) & (a > b) & (b > z), "Bullish stack: ").when((c < a) & (a < b) & (b < z), "Bearish stack: ").when(c > a, "Over EMA20: ").otherwise("Under EMA20: ")
    return p.select(*KEYS, F.concat(head, F.format_string("price %.2f, EMA20 %.2f", half_up(c, 2), half_up(a, 2))).alias("why"))
