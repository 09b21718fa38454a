"""Factor scores from 0 to 100 as columns over bars with indicators; 50 or 0 where history is missing, as each says."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, ratio
from .series import full, last, lookback_return


def _if(c: Column, x: float) -> Column:
    return F.when(c, float(x)).otherwise(0.0)


def trend() -> Column:
    """25 each for close over EMA 20, 20 over 50, 50 over 200, close over 200; 0 before EMA 200 exists."""
    c = F.col("close")
    s = _if(c > F.col("ema20"), 25) + _if(F.col("ema20") > F.col("ema50"), 25) + _if(F.col("ema50") > F.col("ema200"), 25) + _if(c > F.col("ema200"), 25)
    return F.when(F.col("ema200").isNotNull(), s).otherwise(0.0)


def momentum() -> Column:
    """Half MACD (50 if over 0, 50 if over its signal), half RSI; 0 before both exist."""
    m = _if(F.col("macd") > 0, 50) + _if(F.col("macd") > F.col("macd_signal"), 50)
    return F.when(F.col("macd_signal").isNotNull() & F.col("rsi14").isNotNull(), 0.5 * m + 0.5 * F.col("rsi14")).otherwise(0.0)


def volume() -> Column:
    """50 + sign of the 5-day return times how far 5-day volume is over 20-day volume, up to 1, times 50; 0 without 20 bars."""
    over = clamp(ratio(full(F.avg("volume"), 5), full(F.avg("volume"), 20)) - 1, 0, 1)
    return F.coalesce(50 + F.signum(lookback_return(5)) * over * 50, F.lit(0.0))


def volatility(calm: float = 1.5, wild: float = 6.0) -> Column:
    """100 for an ATR of ``calm`` per cent of close and less, 0 from ``wild``, straight between; 50 if there is none."""
    p = F.col("atr14") / F.col("close") * 100
    return F.coalesce(clamp((wild - p) / (wild - calm), 0, 1) * 100, F.lit(50.0))


def atr_percentile(n: int = 100) -> Column:
    """Mid-rank of the ATR share among the last n bars that have one."""
    p = F.when(F.col("atr14").isNotNull(), F.col("atr14") / F.col("close") * 100)
    frame = F.collect_list(p).over(last(n))
    return F.when(p.isNotNull(), (F.size(F.filter(frame, lambda x: x < p)) + 0.5 * F.size(F.filter(frame, lambda x: x == p))) / F.size(frame) * 100)


def relative_strength(bars: DataFrame, bench: DataFrame, n: int = 60, scale: float = 20.0) -> DataFrame:
    """Adds rs: 50 + 50 * excess over the benchmark's own last n bars / scale, within 0 and 100; 0 without history."""
    one = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # the calendar: a row per date
    b = bench.withColumn("_b", F.when(F.lag("bench", n).over(one) > 0, (F.col("bench") - F.lag("bench", n).over(one)) / F.lag("bench", n).over(one) * 100)).select("trade_date", "_b")
    x = bars.withColumn("_r", lookback_return(n)).join(F.broadcast(b), "trade_date", "left")
    return x.withColumn("rs", F.coalesce(50 + 50 * clamp((F.col("_r") - F.col("_b")) / scale, -1, 1), F.lit(0.0))).drop("_r", "_b")


def ranked(value: str, by: list[str]) -> tuple[Column, Column, Column]:
    """How many of ``by`` have a value, how many a lower one, how many the same (where there is a value): frames of one order, so that rows are sorted once."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    below = F.rank().over(w) - 1
    return F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), below, F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - below


def sector_strength(df: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Adds srs: mid-rank of ``value`` among the sector's names of the date, 0 to 100; 50 with fewer than ``least``. A name is its own peer."""
    n, below, equal = ranked(value, ["trade_date", "sector"])
    return df.withColumn("srs", F.when(F.col(value).isNull() | (n < least), 50.0).otherwise((below + 0.5 * equal) / n * 100))


def breadth(df: DataFrame) -> DataFrame:
    """trade_date, breadth: per cent of names over their EMA 50. df: bars with ema50, or with ``over_ema50`` in its place."""
    x = df if "over_ema50" in df.columns else df.withColumn("over_ema50", over_ema50())
    return x.where("over_ema50 IS NOT NULL").groupBy("trade_date").agg((F.avg(F.when(F.col("over_ema50"), 1.0).otherwise(0.0)) * 100).alias("breadth"))


def over_ema50() -> Column:
    """Null before EMA 50 exists."""
    return F.when(F.col("ema50").isNotNull(), F.coalesce(F.col("close") > F.col("ema50"), F.lit(False)))


@dataclasses.dataclass(frozen=True)
class RegimeBounds:
    """Per cent, but for the two of the volatility index. The defaults are for an index that moves by one per cent a day."""

    crash_drop: float = 3.0
    crash_vix: float = 30.0
    high_vix: float = 20.0
    high_atr: float = 2.0
    bull_breadth: float = 55.0
    bear_breadth: float = 40.0


def regime(change: Column, vix: Column, atr_pct: Column, close: Column, ema200: Column, wide: Column, bounds: RegimeBounds = RegimeBounds()) -> Column:
    """CRASH, HIGH_VOL, BULL, BEAR or SIDEWAYS of a date; SIDEWAYS while history is short. The ATR counts only where there is no volatility
    index (null). Arguments are rounded by the caller: change and ATR to 2 places, breadth to 1. No ATR counts as 0, no change as none."""
    above = close > ema200
    return (
        F.when(ema200.isNull(), "SIDEWAYS").when((change <= -bounds.crash_drop) | F.coalesce(vix >= bounds.crash_vix, F.lit(False)), "CRASH")
        .when(F.coalesce(vix >= bounds.high_vix, F.lit(False)) | (vix.isNull() & (F.coalesce(atr_pct, F.lit(0.0)) >= bounds.high_atr)), "HIGH_VOL")
        .when(above & (wide >= bounds.bull_breadth), "BULL").when(~above & (wide <= bounds.bear_breadth), "BEAR").otherwise("SIDEWAYS")
    )


def composite(weights: dict[str, float]) -> Column:
    """Weighted mean of the factors that are there."""
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return F.try_divide(top, sum((F.when(F.col(k).isNotNull(), float(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)))


def agreement(names: list[str]) -> Column:
    """1 less the population deviation of the scores over 50, within 0 and 1; 1 for fewer than two."""
    a = F.filter(F.array(*names), lambda x: x.isNotNull())
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))
    return F.when(F.size(a) < 2, 1.0).otherwise(clamp(1 - sd / 50, 0, 1))


def first_failed(gates: list[tuple[str, Column]], off: tuple[str, ...] = ()) -> Column:
    """The name of the first gate that does not hold (null counts as not), null if all do; gates in ``off`` are left out."""
    on = [(n, c) for n, c in gates if n not in off]
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in on), F.lit(None).cast("string"))


def levels(low15: Column, wild: float = 6.0, loss_band: tuple[float, float] = (0.5, 10.0)) -> dict[str, Column]:
    """Stop, targets and the reason against a signal at the bar's close: an ATR of ``wild`` per cent and more, or a stop outside ``loss_band`` per cent."""
    c, a = F.col("close"), F.col("atr14")
    pct = a / c * 100
    stop = F.greatest(c - F.when(pct < 1.5, 2.0).otherwise(1.5) * a, low15 * 0.997)
    risk = c - stop
    loss = F.try_divide(risk, c) * 100  # what is common to conditions is evaluated on every bar, also where a close is 0
    why = F.when(pct >= wild, "too_volatile").when((loss < loss_band[0]) | (loss > loss_band[1]), "stop_distance")
    return {"stop": stop, "target1": c + 2 * risk, "target2": c + 3 * risk, "reject": why}


