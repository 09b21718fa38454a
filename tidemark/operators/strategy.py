"""The production stack as expressions: blend of buckets, gates, the entry on a pullback, allocation; fundamentals as of a date."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up
from .factors import first_failed, ranked

# Weights of the technical, sentiment and fundamental bucket by regime; any other regime has those of SIDEWAYS.
REGIME_WEIGHTS = {"BULL": (0.5, 0.3, 0.2), "SIDEWAYS": (0.35, 0.25, 0.4), "HIGH_VOL": (0.4, 0.45, 0.15), "BEAR": (0.3, 0.3, 0.4)}
# The composite's threshold and what regimes add to it; floors; the RSI band.
THRESHOLD, THRESHOLD_MORE, TECHNICAL_FLOOR, RSI_BAND = 65.0, {"HIGH_VOL": 5.0, "BEAR": 10.0}, 60.0, (35.0, 68.0)
# The production stack. Sector strength is in, volume is out; floors of two factors.
PRODUCTION_WEIGHTS = {"trend": 0.35, "momentum": 0.3, "rs": 0.25, "srs": 0.25}
FUNDAMENTAL_FLOOR, SENTIMENT_FLOOR = 50.0, 50.0
# The entry in a BULL regime.
PULLBACK_RSI, MOST_EXTENSION = (40.0, 55.0), 2.0
# Budget a slot, slots, per cent of the book at risk, names a sector, costs in per cent and how often a first target must earn them, and where size is cut.
SLOT_BUDGET, SLOTS, RISK_PERCENT, SECTOR_CAP, COST_PERCENT, COST_TIMES, CUT = 100_000.0, 2, 1.0, 1, 0.25, 3.0, (3.0, 6.0, 0.75)
AGREEING = ("trend", "momentum", "rs", "vol")


def by_regime(regime: Column, values: dict[str, float], otherwise: float) -> Column:
    out = F.lit(float(otherwise))
    for k, v in values.items():
        out = F.when(regime == k, float(v)).otherwise(out)
    return out


def blend(regime: Column, technical: Column, sentiment: Column, fundamental: Column) -> Column:
    """Mean of the buckets that are there, weighed by the regime."""
    parts = [(c, by_regime(regime, {k: w[i] for k, w in REGIME_WEIGHTS.items()}, REGIME_WEIGHTS["SIDEWAYS"][i])) for i, c in enumerate((technical, sentiment, fundamental))]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.try_divide(top, sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0)))


def threshold(regime: Column) -> Column:
    return F.lit(THRESHOLD) + by_regime(regime, THRESHOLD_MORE, 0.0)


def momentum_bars(df: DataFrame) -> DataFrame:
    """Adds the rounded readings that gates compare: rsi, hist (unless they are there), and both of the bar before (the bar's own where there is none)."""
    own = Window.partitionBy("instrument_id").orderBy("trade_date")
    hist = F.col("macd") - F.col("macd_signal")
    x = df if "hist" in df.columns else df.withColumn("rsi", half_up(F.col("rsi14"), 2)).withColumn("hist", half_up(hist, 2))
    return x.withColumn("rsi_before", F.coalesce(F.lag("rsi").over(own), F.col("rsi"))).withColumn("hist_before", F.coalesce(F.lag("hist").over(own), F.col("hist")))


def base_gates(override: dict[str, dict[str, float]] | None = None) -> list[tuple[str, Column]]:
    """Gates of every regime. ``override`` may tighten one: rsi_min, rsi_max, least_srs, skip (1: no signals at all), by regime."""
    regime, o = F.col("regime"), override or {}
    pick = lambda k, d: by_regime(regime, {r: v[k] for r, v in o.items() if k in v}, d)
    close, ema20 = half_up(F.col("close"), 2), half_up(F.col("ema20"), 2)
    gates = [
        ("regime", (regime != "CRASH") & (pick("skip", 0.0) == 0)), ("composite", F.col("composite") >= threshold(regime)), ("technical-floor", F.col("technical") >= TECHNICAL_FLOOR),
        ("macd-bullish", F.col("hist") > 0), ("price-above-ema20", close > ema20), ("rsi-band", F.col("rsi").between(pick("rsi_min", RSI_BAND[0]), pick("rsi_max", RSI_BAND[1]))),
    ]
    if any("least_srs" in v for v in o.values()):
        gates.append(("sector-leadership", F.col("srs") >= pick("least_srs", 0.0)))
    return [*gates, ("fundamental-floor", F.col("fundamental") >= FUNDAMENTAL_FLOOR), ("sentiment-factor-floor", F.col("sentiment") >= SENTIMENT_FLOOR)]


def pullback_gates(rising: bool = True) -> list[tuple[str, Column]]:
    """A dip in an uptrend: these stand in a BULL regime instead of the base gates, floors included."""
    close, fast, mid, slow = (half_up(F.col(c), 2) for c in ("close", "ema20", "ema50", "ema200"))
    gates = [("uptrend-stack", (fast > mid) & (mid > slow)), ("above-ema50", close > mid), ("pullback-not-extended", F.try_divide(close - fast, fast) * 100 <= MOST_EXTENSION), ("pullback-rsi", F.col("rsi").between(*PULLBACK_RSI))]
    return [*gates, ("histogram-rising", F.col("hist") > F.col("hist_before"))] if rising else gates


def may_pass() -> Column:
    """False where a bar's own rsi, hist, close and averages fail both the base gates and the pullback's, whatever its date, its peers and the bar before are."""
    holds = lambda gates: functools.reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in gates))
    base = dict(base_gates())
    return holds(base[g] for g in ("macd-bullish", "price-above-ema20", "rsi-band")) | holds(c for _, c in pullback_gates(rising=False))


def production_failure(off: tuple[str, ...] = (), override: dict[str, dict[str, float]] | None = None) -> Column:
    """The first gate that fails, null if all hold."""
    dip = first_failed(pullback_gates())
    return F.when(F.col("regime") == "BULL", F.concat(F.lit("bull-pullback:"), dip)).otherwise(first_failed(base_gates(override), off))


def cooled(signals: DataFrame, key: str, at: str, days: int = 5) -> DataFrame:
    """Signals that are ``days`` and more after the last one kept of their key, in order. A fold over the key's own rows in the JVM, which move once; only what passed all gates comes here, once a date."""
    all_ = F.sort_array(F.collect_list(F.struct(at, *(c for c in signals.columns if c not in (key, at)))))
    later = lambda kept, x: F.coalesce(F.datediff(x[at], F.try_element_at(kept, F.lit(-1))[at]) >= days, F.lit(True))
    keep = F.aggregate(F.col("_k"), F.slice("_k", 1, 0), lambda kept, x: F.when(later(kept, x), F.array_append(kept, x)).otherwise(kept))
    return signals.groupBy(key).agg(all_.alias("_k")).select(key, F.explode(keep).alias("_x")).select(key, "_x.*")


def allocate(candidates: DataFrame, day: str, score: str, tie: str) -> DataFrame:
    """Adds qty and verdict (null: approved) to a day's candidates (entry, stop, target1, atr_pct, sector), in order of score.

    Sized by risk, then what is too small or earns too little for its costs goes. The rest take the slots in order, at most
    SECTOR_CAP a sector: among them those within their sector's cap are counted, which needs no loop.
    """
    risk = F.col("entry") - F.col("stop")
    qty = F.least(F.floor(F.try_divide(F.lit(SLOT_BUDGET * SLOTS * RISK_PERCENT / 100), risk)), F.floor(F.try_divide(F.lit(SLOT_BUDGET), F.col("entry"))))
    qty = F.when(risk > 0, qty).otherwise(0)
    low, high, part = CUT
    qty = F.when((F.col("atr_pct") >= low) & (F.col("atr_pct") < high), F.floor(qty * part)).otherwise(qty)
    x = candidates.withColumn("qty", F.coalesce(qty, F.lit(0)).cast("long"))
    poor = F.col("qty") * (F.col("target1") - F.col("entry")) < COST_TIMES * half_up(F.col("qty") * F.col("entry"), 2) * COST_PERCENT / 100
    x = x.withColumn("verdict", F.when(F.col("qty") < 1, "sizing").when(poor, "cost-drag"))
    order = [F.desc(score), F.col(tie)]
    open_ = F.col("verdict").isNull()
    in_sector = F.sum(open_.cast("int")).over(Window.partitionBy(day, "sector").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("fits", open_ & (F.col("sector").isNull() | (in_sector <= SECTOR_CAP)))
    before = F.coalesce(F.sum(F.col("fits").cast("int")).over(Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("verdict", F.when(~open_, F.col("verdict")).when(before >= SLOTS, "position-limit").when(~F.col("fits"), "sector-cap")).drop("fits")


# ---------------------------------------------------------------- fundamentals

def known_quarters(quarters: DataFrame, key: str) -> DataFrame:
    """key, usable_from, state: what is known from a day on. quarters: key, period_end, eps, available (a date), usable_from.

    A row for each day on which something of a key becomes known, so a date needs one look-up and no join with all quarters.
    A key's quarters are four a year.
    """
    all_ = F.collect_list(F.struct("period_end", "eps", "available")).over(Window.partitionBy(key).orderBy("usable_from").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    q = quarters.select(key, "usable_from", F.sort_array(all_, asc=False).alias("q")).dropDuplicates([key, "usable_from"])
    four = lambda k: F.when(F.size("q") >= k + 3, F.aggregate(F.slice("q", k, 4), F.lit(0.0), lambda s, x: s + x["eps"]))
    state = F.struct(F.size("q").alias("known"), four(1).alias("ttm"), four(5).alias("before"), F.get("q", F.lit(0))["period_end"].alias("last_period"), F.array_max(F.transform("q", lambda x: x["available"])).alias("last_available"))
    return q.select(key, "usable_from", state.alias("state"))


def price_earnings(price: Column, ttm: Column) -> Column:
    return F.when((ttm > 0) & (price > 0), price / ttm)


def growth(ttm: Column, before: Column, cap: float = 40.0) -> Column:
    return F.when(before > 0, 50 + clamp((ttm - before) / before * 100 / cap, -1, 1) * 50).when((before <= 0) & (ttm > 0), 100.0)


def results_pending(date: Column, state: Column) -> Column:
    """A calendar quarter has ended before the date and is not known yet."""
    return F.coalesce((state["known"] > 0) & (state["last_period"] < F.date_sub(F.trunc(date, "quarter"), 1)), F.lit(False))


def fundamental(df: DataFrame, day: str = "trade_date", sector: str = "sector", least: int = 3, cap: float = 40.0) -> DataFrame:
    """Adds value, growth (unless it is there) and fundamental to rows with pe, ttm, before: cheapness by mid-rank in the sector on
    the day, growth of trailing earnings; 0.6 and 0.4 of what is there, 50 if nothing is."""
    n, below, equal = ranked("pe", [day, sector])
    value = F.when(F.col("pe").isNotNull() & F.col(sector).isNotNull() & (n >= least), (n - below - equal + 0.5 * equal) / n * 100)
    x = df.withColumn("value", value)
    x = x if "growth" in df.columns else x.withColumn("growth", growth(F.col("ttm"), F.col("before"), cap))
    weights = F.when(F.col("value").isNotNull(), 0.6).otherwise(0.0) + F.when(F.col("growth").isNotNull(), 0.4).otherwise(0.0)
    score = F.try_divide(F.coalesce(F.col("value") * 0.6, F.lit(0.0)) + F.coalesce(F.col("growth") * 0.4, F.lit(0.0)), F.nullif(weights, F.lit(0.0)))
    return x.withColumn("fundamental", F.coalesce(half_up(score, 2), F.lit(50.0)))
