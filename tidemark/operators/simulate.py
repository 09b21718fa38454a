"""Path-dependent work: cooldowns, trades, the book, folds. Groups are one instrument's bars, or one configuration's trades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exits:
    """When a trade ends: days, targets in risks, share taken at the first, costs."""

    name: str = "base"
    days: int = 7
    target1: float = 2.0
    target2: float = 3.0
    part: float = 0.5
    slippage: float = 0.0005
    cost: float = 0.0005
    cooldown: int = 5


def cooled(days: np.ndarray, gap: int) -> np.ndarray:
    """Which of an instrument's sorted signal days stay: at least ``gap`` days after the last that stayed."""
    keep, last = np.zeros(len(days), bool), None
    for i, d in enumerate(days.tolist()):
        if last is None or d - last >= gap:
            keep[i], last = True, d
    return keep


def trade(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, day: np.ndarray, broken: np.ndarray, at: int, stop: float, x: Exits) -> tuple[int, float, str] | None:
    """One trade from the bar after ``at``: last bar, net return in per cent, why it ended. The stop fills at its price, gaps included.

    On a bar the stop comes first; then the first target, which takes a part and lifts the stop to the entry (the second may fill the
    same day); after a first target the bar's other checks are left out; then time; then a broken thesis.
    """
    i = at + 1
    if i >= len(close):
        return None
    entry = float(np.round(open_[i] * (1 + x.slippage), 2))
    risk = entry - stop
    if not entry > 0 or not risk > 0:
        return None
    t1, t2 = entry + x.target1 * risk, entry + x.target2 * risk
    left, gain, why, k = 1.0, 0.0, "end", i
    for k in range(i, len(close)):
        if low[k] <= stop:
            gain, left, why = gain + left * (stop - entry), 0.0, "stop"
            break
        if left == 1.0 and high[k] >= t1:
            gain, left, stop = gain + x.part * (t1 - entry), 1.0 - x.part, entry
            if high[k] >= t2:
                gain, left, why = gain + left * (t2 - entry), 0.0, "target2"
                break
            continue
        if left < 1.0 and high[k] >= t2:
            gain, left, why = gain + left * (t2 - entry), 0.0, "target2"
            break
        if day[k] - day[i] >= x.days:
            why = "time"
            break
        if broken[k]:
            why = "thesis"
            break
    gain += left * (close[k] - entry)
    return k, gain / entry * 100 - 2 * x.cost * 100, why


TRADES = "config string, instrument_id long, signal_date date, entry_date date, exit_date date, net double, reason string"


def trades(signals: DataFrame, configs: list[Exits]) -> DataFrame:
    """Every signal's trade under every configuration. signals: bars with trend (ema20, macd, macd_signal), ``stop`` and the flag ``signal``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("trade_date")
        o, h, l, c, e = (p[x].to_numpy(float) for x in ("open", "high", "low", "close", "ema20"))  # noqa: E741
        day = pd.to_datetime(p["trade_date"]).to_numpy().astype("datetime64[D]").astype(int)
        under = c < e
        macd = p["macd"].to_numpy(float) > p["macd_signal"].to_numpy(float)
        broken = np.zeros(len(p), bool)
        broken[1:] = (under[1:] & under[:-1]) | (~macd[1:] & macd[:-1])
        at, stop = np.flatnonzero(p["signal"].to_numpy(bool)), p["stop"].to_numpy(float).tolist()
        days = day[at]
        # Loops over bars read plain numbers, which takes a fraction of the time of an array's.
        o, h, l, c, day, broken = (v.tolist() for v in (o, h, l, c, day, broken))  # noqa: E741
        who = int(p["instrument_id"].iloc[0])
        dates, out = p["trade_date"].to_numpy(), []
        for x in configs:
            for i in at[cooled(days, x.cooldown)].tolist():
                if t := trade(o, h, l, c, day, broken, i, stop[i], x):
                    out.append((x.name, who, dates[i], dates[i + 1], dates[t[0]], t[1], t[2]))
        return pd.DataFrame(out, columns=[s.split()[0] for s in TRADES.split(", ")])

    return signals.groupBy("instrument_id").applyInPandas(run, TRADES)


def folds(calendar: DataFrame, n: int, embargo: int) -> DataFrame:
    """fold, train_from, train_to, test_from, test_to: expanding; days numbered in order, the last fold to the end. calendar has a row a date."""
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    c = calendar.withColumn("i", F.row_number().over(w) - 1).withColumn("size", F.floor(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / (n + 1)))
    k = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("fold"))
    train = F.col("i") < F.col("fold") * F.col("size")
    test = (F.col("i") >= F.col("fold") * F.col("size") + embargo) & ((F.col("fold") == n) | (F.col("i") < (F.col("fold") + 1) * F.col("size")))
    d = lambda f, c: f(F.when(c, F.col("trade_date")))
    return k.groupBy("fold").agg(d(F.min, train).alias("train_from"), d(F.max, train).alias("train_to"), d(F.min, test).alias("test_from"), d(F.max, test).alias("test_to"))


def walk_forward(done: DataFrame, windows: DataFrame) -> DataFrame:
    """Per fold the configuration with the best mean in training (then its name), and how its trades did in the test window."""
    j = done.join(F.broadcast(windows), F.col("signal_date").between(F.col("train_from"), F.col("test_to")))  # one row a fold
    g = j.groupBy("fold", "config").agg(
        F.avg(F.when(F.col("exit_date") <= F.col("train_to"), F.col("net"))).alias("train"),
        F.avg(F.when(F.col("signal_date") >= F.col("test_from"), F.col("net"))).alias("test"), F.count(F.when(F.col("signal_date") >= F.col("test_from"), 1)).alias("n_test"),
    )
    best = F.min_by(F.struct("config", "train", "test", "n_test"), F.struct((-F.coalesce("train", F.lit(-1e18))).alias("t"), "config"))
    return g.groupBy("fold").agg(best.alias("b")).select("fold", "b.*")


BOOK = "config string, trade_date date, equity double, cash double, open_slots int, taken int, skipped int"


def book(done: DataFrame, slots: int = 5, cash: float = 100_000.0, share: float = 0.2) -> DataFrame:
    """Equity of a book that takes trades in order of (entry date, instrument) while it has slots; entries of a day come before its exits.

    A trade's value moves at its exit. A configuration's trades come to a task in order and are read once: what is held is the open slots
    and the dates of exits to come.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = [s.split()[0] for s in BOOK.split(", ")], []
        config, money, held, ahead, today, taken, skipped = None, cash, [], set(), None, 0, 0

        def end(before) -> None:
            """Days before a date, or all that are left."""
            nonlocal money, held, taken, skipped
            for d in sorted(x for x in ahead if before is None or x < before):
                ahead.remove(d)
                for x in [x for x in held if x[0] <= d]:
                    money = round(money + x[1] * (1 + x[2] / 100), 2)
                    held.remove(x)
                out.append((config, d, money + sum(x[1] for x in held), money, slots - len(held), taken, skipped))
                taken = skipped = 0

        for p in pdfs:
            for t in p.itertuples():
                if t.config != config:
                    end(None)
                    config, money, held, today = t.config, cash, [], None
                if t.entry_date != today:
                    end(t.entry_date)
                    today = t.entry_date
                size = min(money, share * (money + sum(x[1] for x in held)))
                if len(held) < slots and size > 0:
                    held.append((t.exit_date, size, t.net))
                    money -= size
                    taken += 1
                else:
                    skipped += 1
                ahead |= {t.entry_date, t.exit_date}
            yield pd.DataFrame(out, columns=names)
            out.clear()
        end(None)
        yield pd.DataFrame(out, columns=names)

    ordered = done.repartition("config").sortWithinPartitions("config", "entry_date", "instrument_id", "signal_date")
    return ordered.mapInPandas(run, BOOK)


# ---------------------------------------------------------------- seeded bootstrap

def mulberry32(seed: int):
    """A generator of floats in [0, 1) from 32-bit integer arithmetic."""
    a = seed & 0xFFFFFFFF

    def step() -> float:
        nonlocal a
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return step


def stationary_bootstrap(series: DataFrame, value: str, order: str, by: str, reps: int = 1000, block: int = 20, seed: int = 7) -> DataFrame:
    """by, mean, low, high: 95 % interval of the mean from circular blocks of geometric length. A group is one series of a value a date; groups run in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        rnd, n = mulberry32(seed), len(x)
        means = np.empty(reps)
        for r in range(reps):
            i, total = int(rnd() * n), 0.0
            for _ in range(n):
                total += x[i]
                i = int(rnd() * n) if rnd() < 1 / block else (i + 1) % n
            means[r] = total / n
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high]})

    kind = series.schema[by].dataType.simpleString()
    return series.groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double")


# ---------------------------------------------------------------- splits

def split_adjusted(bars: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds ratio (previous close / open where it is off by ``least`` and more, else 1) and bars before it adjusted: prices over, volume times the later ratios' product."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    x = bars.withColumn("ratio", F.try_divide(F.lag("close").over(w), F.col("open")))
    x = x.withColumn("ratio", F.when(F.abs(F.col("ratio") - 1) >= least, F.col("ratio")).otherwise(1.0)).withColumn("ratio", F.when(F.col("ratio") > 0, F.col("ratio")).otherwise(1.0))
    later = F.exp(F.coalesce(F.sum(F.log("ratio")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    x = x.withColumn("_f", later)
    return x.select(*[c for c in bars.columns if c not in ("open", "high", "low", "close", "volume")], "ratio", *((F.col(c) / F.col("_f")).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") * F.col("_f")).alias("volume"))
