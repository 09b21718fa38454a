"""What gates, floors and overrides are worth, and how sure a ledger's figures are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import unit
from ..functions.numbers import half_up, ratio
from ..operators import ablation
from ..operators import cross as X
from ..operators import factors as E
from ..operators import resampling
from ..operators import series as S
from ..operators import strategy as P
from ..sources.shared import written
from .cross_queries import _IC, _PANEL, monthly_panel
from .registry import query, r
from .series_queries import KEYS, W
from .strategy_queries import _ALLOCATED, _SIGNALS, _STACK, signals, stack

REGIMES = ("BULL", "BEAR", "SIDEWAYS", "HIGH_VOL", "CRASH")
FUNDAMENTAL_LEVELS, SENTIMENT_LEVELS = (40, 45, 50, 55), (40, 45, 48, 50, 55)
_BASE = ("composite", "technical-floor", "macd-bullish", "price-above-ema20", "rsi-band")
_DIP = ("uptrend-stack", "above-ema50", "pullback-not-extended", "pullback-rsi", "histogram-rising")
_FLOORS = ("fundamental>=50", "sentiment>=50")


def gates() -> dict:
    own = dict(P.base_gates())
    found = {g: own[g] for g in _BASE}
    found |= {f"fundamental>={v}": F.col("fundamental") >= v for v in FUNDAMENTAL_LEVELS} | {f"sentiment>={v}": F.col("sentiment") >= v for v in SENTIMENT_LEVELS}
    return found | dict(P.pullback_gates())


def masks() -> dict[str, dict[str, tuple[str, ...]]]:
    """Gates that stand in each regime, for the production stack and for each change of it. Nothing is traded in a CRASH but where that gate is off."""
    def of(base=(*_BASE, *_FLOORS), dip=_DIP, skip=("CRASH",)):
        return {g: dip if g == "BULL" else base for g in REGIMES if g not in skip}

    full = (*_BASE, *_FLOORS)
    out = {"production": of(), "no regime": of(skip=()), "base gates in BULL": of(dip=full)}
    out |= {f"no {g}": of(tuple(x for x in full if x != g)) for g in full} | {f"no {g}": of(dip=tuple(x for x in _DIP if x != g)) for g in _DIP}
    out |= {f"fundamental>={v}": of((*_BASE, f"fundamental>={v}", _FLOORS[1])) for v in FUNDAMENTAL_LEVELS} | {f"sentiment>={v}": of((*_BASE, _FLOORS[0], f"sentiment>={v}")) for v in SENTIMENT_LEVELS}
    return out | {f"no {g}": of(skip=("CRASH", g)) for g in ("BULL", "BEAR", "SIDEWAYS", "HIGH_VOL")} | {"no floors": of(_BASE), "no gates": of((), (), ())}


_SAID = {
    "composite": "composite >= 65 + CASE regime WHEN 'BEAR' THEN 10 WHEN 'HIGH_VOL' THEN 5 ELSE 0 END", "technical-floor": "technical >= 60", "macd-bullish": "hist > 0", "price-above-ema20": "c > e2", "rsi-band": "rsi BETWEEN 35 AND 68",
    "uptrend-stack": "e2 > e5 AND e5 > e9", "above-ema50": "c > e5", "pullback-not-extended": "(c - e2) / nullif(e2, 0) * 100 <= 2", "pullback-rsi": "rsi BETWEEN 40 AND 55", "histogram-rising": "hist > hist_before",
}


def _passes(by: dict[str, tuple[str, ...]]) -> str:
    return "CASE regime " + " ".join(f"WHEN '{g}' THEN " + (" AND ".join(f"coalesce({_SAID.get(x, x)}, false)" for x in on) or "true") for g, on in by.items()) + " ELSE false END"


_NET = f"ne AS (SELECT instrument_id, trade_date, {r(f'(lead(close, 6) OVER ({W}) - lead(close, 1) OVER ({W})) / lead(close, 1) OVER ({W}) * 100', 2)} AS net FROM bars)"
_K = "CAST(floor(net * 100 + 0.5) AS BIGINT)"


@query(f"""{_STACK}, {_NET}, gb AS (SELECT pg.*, {_K} AS k FROM pg JOIN ne ON ne.instrument_id = pg.instrument_id AND ne.trade_date = pg.trade_date WHERE ema200 IS NOT NULL AND net IS NOT NULL),
gc AS ({" UNION ALL ".join(f"SELECT '{c}' AS config, count(*) AS n, count(*) FILTER (WHERE k > 0) AS wins, coalesce(sum(k) FILTER (WHERE k > 0), 0) AS gain, coalesce(-sum(k) FILTER (WHERE k <= 0), 0) AS loss FROM gb WHERE {_passes(by)}" for c, by in masks().items())})
SELECT config, n, CASE WHEN n > 0 THEN {r('wins / n::DOUBLE * 100', 2)} END AS win_rate, CASE WHEN n > 0 THEN {r('(gain - loss) / n::DOUBLE / 100', 3)} END AS expectancy, CASE WHEN loss > 0 THEN {r('gain / loss::DOUBLE', 3)} END AS profit_factor FROM gc""")
def gate_outcomes(spark, sf) -> DataFrame:
    """Five-bar outcomes under every ablation of a gate, level of a floor and override of a regime, all read from one count of the bars."""
    p = stack(spark, sf, lambda x: x.withColumn("net", half_up(S.forward_return(5), 2))).where("ema200 IS NOT NULL")
    cube = ablation.outcome_cube(p, "regime", gates(), "net")
    return ablation.outcomes(cube, ablation.configurations(spark, list(gates()), masks()))


REPS, BLOCK, SEED = 400, 20, 20260722


def ledger(spark, sf) -> DataFrame:
    """series (ALL and the regime), instrument_id, trade_date, k (what a signal earned in five bars, in hundredths of a per cent)."""
    x = signals(spark, sf, ("net",)).where("net IS NOT NULL").select(*KEYS, F.explode(F.array(F.lit("ALL"), F.col("regime"))).alias("series"), F.floor(F.col("net") * 100 + 0.5).alias("k"))
    return x.select("series", *KEYS, F.greatest("k", F.lit(0)).alias("gain"), F.greatest(-F.col("k"), F.lit(0)).alias("loss"))


@query(f"""{_SIGNALS}, {_NET}, lk AS (SELECT unnest(['ALL', regime]) AS series, s.instrument_id, s.trade_date, {_K} AS k FROM sg2 s JOIN ne ON ne.instrument_id = s.instrument_id AND ne.trade_date = s.trade_date WHERE net IS NOT NULL),
ld AS (SELECT series, greatest(k, 0) AS gain, greatest(-k, 0) AS loss, row_number() OVER (PARTITION BY series ORDER BY trade_date, instrument_id) - 1 AS n FROM lk),
{resampling.sql("ld", REPS, BLOCK, SEED, ["gain", "loss"])},
sv AS (SELECT series, (gain - loss) / size::DOUBLE / 100 AS expectancy, CASE WHEN loss > 0 THEN gain / loss::DOUBLE END AS pf FROM drawn),
ot AS (SELECT series, count(*) AS n, (sum(gain) - sum(loss)) / count(*)::DOUBLE / 100 AS expectancy, CASE WHEN sum(loss) > 0 THEN sum(gain) / sum(loss)::DOUBLE END AS pf FROM ld GROUP BY series)
SELECT series, any_value(n) AS n, any_value({r('ot.expectancy', 3)}) AS expectancy, {r('quantile_cont(sv.expectancy, 0.025)', 3)} AS expectancy_low, {r('quantile_cont(sv.expectancy, 0.975)', 3)} AS expectancy_high,
  any_value({r('ot.pf', 3)}) AS profit_factor, {r('quantile_cont(sv.pf, 0.025)', 3)} AS pf_low, {r('quantile_cont(sv.pf, 0.975)', 3)} AS pf_high FROM sv JOIN ot USING (series) GROUP BY series""")
def expectancy_interval(spark, sf) -> DataFrame:
    """Expectancy and profit factor of the signals' five-bar trades with 95 % intervals, of all and by regime. A resample without a loss has no profit factor."""
    rows = written(ledger(spark, sf), "ledger")
    d = resampling.replicates(rows, "series", "trade_date", ["instrument_id"], ["gain", "loss"], REPS, BLOCK, SEED)
    pf = lambda g, l: ratio(g, F.nullif(l, F.lit(0)))  # noqa: E731, E741
    d = d.select("series", ((F.col("gain") - F.col("loss")) / F.col("size") / 100).alias("e"), pf(F.col("gain"), F.col("loss")).alias("p"))
    n = F.count(F.lit(1))
    own = rows.groupBy("series").agg(n.alias("n"), half_up((F.sum("gain") - F.sum("loss")) / n / 100, 3).alias("expectancy"), half_up(pf(F.sum("gain"), F.sum("loss")), 3).alias("profit_factor"))
    ends = d.groupBy("series").agg(*(half_up(F.percentile(c, F.lit(q)), 3).alias(f"{name}_{side}") for c, name in (("e", "expectancy"), ("p", "pf")) for q, side in ((0.025, "low"), (0.975, "high"))))
    return own.join(ends, "series").select("series", "n", "expectancy", "expectancy_low", "expectancy_high", "profit_factor", "pf_low", "pf_high")


@query(f"""WITH {_PANEL}, {_IC}, ld AS (SELECT subject || '-' || h AS series, CAST(floor(ic * 1000 + 0.5) AS BIGINT) AS k, row_number() OVER (PARTITION BY subject, h ORDER BY trade_date) - 1 AS n FROM ic),
{resampling.sql("ld", REPS, BLOCK, 12345, ["k"])}, ot AS (SELECT series, sum(k) / count(*)::DOUBLE / 1000 AS mean FROM ld GROUP BY series)
SELECT series, any_value(size) AS n, any_value({r('mean')}) AS mean, {r('quantile_cont(k / size::DOUBLE / 1000, 0.025)')} AS low, {r('quantile_cont(k / size::DOUBLE / 1000, 0.975)')} AS high FROM drawn JOIN ot USING (series) GROUP BY series""")
def ic_interval(spark, sf) -> DataFrame:
    """Mean of each series of rank correlations with its 95 % interval; correlations have three places, so they are whole thousandths."""
    ic = X.spearman(monthly_panel(spark, sf), "score", "fwd", ["subject", "h", "trade_date"]).select(F.concat_ws("-", "subject", "h").alias("series"), "trade_date", F.floor(F.col("ic") * 1000 + 0.5).alias("k"))
    d = resampling.replicates(ic, "series", "trade_date", [], ["k"], REPS, BLOCK, 12345).withColumn("m", F.col("k") / F.col("size") / 1000)
    own = ic.groupBy("series").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("k") / F.count(F.lit(1)) / 1000).alias("mean"))
    return own.join(resampling.interval(d, ["series"], "m"), "series").select("series", "n", "mean", half_up(F.col("low")).alias("low"), half_up(F.col("high")).alias("high"))


_RANKS = ("composite", "random", "sentiment", "srs", "fundamental", "calm", "tight-stop", "agreement")
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ord(z) AS BIGINT) FOR z IN string_split(concat(s.instrument_id, '|', strftime(s.trade_date, '%Y-%m-%d')), '')]), lambda a, b: (xor(a, b) * 16777619) & 4294967295) / 4294967296.0::DOUBLE"


@query(f"""{_SIGNALS}, rs8 AS (SELECT s.instrument_id, s.trade_date, s.composite, {_FNV} AS random, pg.sentiment, pg.srs, pg.fundamental, pg.calm, -((s.entry - s.stop) / s.entry) * 100 AS tight,
  {r('greatest(0, least(1, 1 - list_aggregate([pg.trend, pg.momentum, pg.rs, pg.vol], ' + chr(39) + 'stddev_pop' + chr(39) + ') / 50))')} AS agreement FROM sg2 s JOIN pg ON pg.instrument_id = s.instrument_id AND pg.trade_date = s.trade_date),
rl AS (SELECT instrument_id, trade_date, unnest([{", ".join(f"'{k}'" for k in _RANKS)}]) AS rank_key, unnest([composite, random, sentiment, srs, fundamental, calm, tight, agreement]) AS score FROM rs8)
SELECT instrument_id, trade_date, rank_key, row_number() OVER (PARTITION BY trade_date, rank_key ORDER BY score DESC, instrument_id) AS place FROM rl""")
def slot_ranks(spark, sf) -> DataFrame:
    """The order of each day's signals for its slots under the eight keys; the random one is a hash of name and day. Ties: the smaller name."""
    x = signals(spark, sf, ("sentiment", "srs", "fundamental", "calm", half_up(E.agreement(list(P.AGREEING))).alias("agreement")))
    name = F.concat_ws("|", F.col("instrument_id").cast("string"), F.date_format("trade_date", "yyyy-MM-dd"))
    scores = {"composite": F.col("composite"), "random": unit(name), "tight-stop": -((F.col("entry") - F.col("stop")) / F.col("entry")) * 100}
    long = x.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(k).alias("rank_key"), (scores[k] if k in scores else F.col(k)).cast("double").alias("score")) for k in _RANKS))).alias("x")).select(*KEYS, "x.*")
    return long.select(*KEYS, "rank_key", F.row_number().over(Window.partitionBy("trade_date", "rank_key").orderBy(F.desc("score"), "instrument_id")).cast("long").alias("place"))


@query(f"""{_ALLOCATED}, {_NET}, av2 AS (SELECT CASE WHEN v IS NOT NULL THEN v WHEN b4 >= 2 THEN 'position-limit' WHEN NOT fits THEN 'sector-cap' ELSE 'taken' END AS verdict, {_K} AS k FROM aw JOIN ne ON ne.instrument_id = aw.instrument_id AND ne.trade_date = aw.trade_date WHERE net IS NOT NULL),
am2 AS (SELECT count(*) FILTER (WHERE verdict = 'taken') AS taken, count(*) FILTER (WHERE verdict = 'position-limit') AS skipped, coalesce(sum(k) FILTER (WHERE verdict = 'taken'), 0) AS a, coalesce(sum(k) FILTER (WHERE verdict = 'position-limit'), 0) AS b FROM av2)
SELECT taken, skipped, {r('a / greatest(taken, 1)::DOUBLE / 100', 3)} AS taken_mean, {r('b / greatest(skipped, 1)::DOUBLE / 100', 3)} AS skipped_mean, {r('a / greatest(taken, 1)::DOUBLE / 100 - b / greatest(skipped, 1)::DOUBLE / 100', 3)} AS edge FROM am2""")
def slot_regret(spark, sf) -> DataFrame:
    """What signals that got a slot earned in five bars, against those that the day's slots ran out for; a side without signals counts as 0."""
    x = P.allocate(signals(spark, sf, ("net",)), "trade_date", "composite", "instrument_id").where("net IS NOT NULL").select("verdict", F.floor(F.col("net") * 100 + 0.5).alias("k"))
    taken, skipped = F.col("verdict").isNull(), F.col("verdict") == "position-limit"
    s = x.agg(*(F.count(F.when(c, 1)).alias(f"n_{n}") for n, c in (("t", taken), ("s", skipped))), *(F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).alias(f"k_{n}") for n, c in (("t", taken), ("s", skipped))))
    mean = lambda n: F.col(f"k_{n}") / F.greatest(F.col(f"n_{n}"), F.lit(1)) / 100
    return s.select(F.col("n_t").alias("taken"), F.col("n_s").alias("skipped"), half_up(mean("t"), 3).alias("taken_mean"), half_up(mean("s"), 3).alias("skipped_mean"), half_up(mean("t") - mean("s"), 3).alias("edge"))
