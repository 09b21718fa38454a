from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ablation, recurrence, resampling
from tidemark.operators import factors as E
from tidemark.operators import series as S

BARS = "instrument_id long, trade_date date, open double, high double, low double, close double, volume double"


def walk(name, n, seed, step=1):
    rng, out, day, c = random.Random(seed), [], dt.date(2000, 1, 1), 100.0
    for _ in range(n):
        day, c = day + dt.timedelta(rng.randint(1, step)), max(1.0, c + rng.gauss(0, 3))
        out.append((name, day, c, c * 1.02, c * 0.97, c, 10.0))
    return out


@pytest.mark.parametrize("size", [2, 7, 256])
def test_a_scan_over_blocks_is_the_recursion(spark, size, monkeypatch):
    """Every block length gives what one pass over the series gives: in blocks of blocks of two bars as well, and across gaps."""
    monkeypatch.setattr(recurrence, "SIZE", size)
    rows = walk(1, 260, 1) + walk(2, 30, 2, 40) + walk(3, 1, 3) + walk(None, 50, 4)
    bars = spark.createDataFrame(rows, BARS)
    want = {(r.instrument_id, r.trade_date): r for r in S.indicators(bars).collect()}
    got = S.indicators_scan(bars).collect()
    assert len(got) == len(rows) and S.indicators_scan(bars.limit(0)).count() == 0
    for r in got:
        w = want[r.instrument_id, r.trade_date]
        assert r.close == w.close
        for c in S.INDICATORS:
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or r[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9)), c


def test_a_long_series_is_many_tasks(spark):
    """One series of 200,000 bars: the blocks are dealt out, and the last average is that of one pass."""
    n = 200_000
    bars = spark.range(n).select(F.lit(1).cast("long").alias("instrument_id"), F.date_add(F.lit("1500-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"), *((100 + F.sin("id") * 5 + F.lit(d)).alias(c) for c, d in (("high", 1), ("low", -1), ("close", 0))))
    x = S.indicators_scan(bars)
    last = x.orderBy(F.desc("trade_date")).first()
    close = 100 + np.sin(np.arange(n)) * 5
    assert last.ema200 == pytest.approx(S.ema(close, 200)[-1], rel=1e-9) and last.rsi14 == pytest.approx(S.rsi(close)[-1], rel=1e-9) and last.macd_signal == pytest.approx(S.macd(close)[1][-1], rel=1e-6, abs=1e-9)
    assert x.groupBy(F.spark_partition_id()).count().count() > 1


def regime_of(change, vix, atr, close, ema, wide):
    if ema is None:
        return "SIDEWAYS"
    if change <= -3 or vix is not None and vix >= 30:
        return "CRASH"
    if vix is not None and vix >= 20 or vix is None and atr >= 2:
        return "HIGH_VOL"
    if close > ema and wide >= 55:
        return "BULL"
    return "BEAR" if close <= ema and wide <= 40 else "SIDEWAYS"


def test_regimes_at_every_bound(spark):
    rows = list(itertools.product([-3.01, -3.0, -2.99, 1.0], [None, 19.99, 20.0, 29.99, 30.0], [0.0, 1.99, 2.0], [99.99, 100.0, 100.01], [None, 100.0], [39.9, 40.0, 40.1, 54.9, 55.0]))
    df = spark.createDataFrame(rows, "change double, vix double, atr double, close double, ema double, wide double")
    got = df.select(*df.columns, E.regime(*(F.col(c) for c in df.columns)).alias("r")).collect()
    assert all(r.r == regime_of(*r[:6]) for r in got)


def test_outcomes_from_the_cube_are_those_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("AB"), rng.choice([True, False, None]), rng.random() < 0.7, rng.random() < 0.8, rng.choice([None, round(rng.gauss(0, 2), 2), 0.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "regime string, x boolean, y boolean, z boolean, net double")
    masks = {"all": {"A": ("x", "y"), "B": ("z",)}, "one": {"A": ()}, "none": {"C": ("x",)}, "every": {"A": ("x", "y", "z"), "B": ("x", "y", "z")}}
    cube = ablation.outcome_cube(df, "regime", {k: F.col(k) for k in "xyz"}, "net")
    assert cube.count() <= 2 * 8
    got = {r.config: r for r in ablation.outcomes(cube, ablation.configurations(spark, "xyz", masks)).collect()}
    for config, by in masks.items():
        nets = [r[4] for r in rows if r[4] is not None and r[0] in by and all(dict(zip("xyz", r[1:4], strict=True))[g] for g in by[r[0]])]
        assert got[config].n == len(nets)
        if nets:
            assert got[config].expectancy == pytest.approx(sum(nets) / len(nets), abs=6e-4) and got[config].win_rate == pytest.approx(100 * sum(x > 0 for x in nets) / len(nets), abs=6e-3)
            assert got[config].profit_factor == pytest.approx(sum(x for x in nets if x > 0) / -sum(x for x in nets if x < 0), abs=6e-4)
        else:
            assert got[config].expectancy is None and got[config].profit_factor is None


@pytest.mark.parametrize("piece", [3, 4096])
def test_resamples_are_those_drawn_place_by_place(spark, piece, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(2)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 9)), i, rng.choice([None, *range(-50, 50)])) for s, n in (("a", 57), ("b", 1), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, day date, tie int, k long").repartition(5)
    got = {(r.series, r.replicate): (r.size, r.k) for r in resampling.replicates(df, "series", "day", ["tie"], ["k"], 30, 4, 9).collect()}
    want = {}
    for s in ("a", "b", None):
        values = [r[3] or 0 for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))]
        for rep in range(30):
            total = at = 0
            for t in range(len(values)):
                h = hashlib.md5(f"9:{rep}:{t}".encode()).hexdigest()
                at = int(h[8:16], 16) % len(values) if t == 0 or int(h[:8], 16) % 4 == 0 else (at + 1) % len(values)
                total += values[at]
            want[s, rep] = len(values), total
    assert got == want and resampling.replicates(df.limit(0), "series", "day", ["tie"], ["k"], 3, 4, 9).count() == 0
