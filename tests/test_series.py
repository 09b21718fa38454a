from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_up, to_fixed
from tidemark.operators import cross as X
from tidemark.operators import series as S


def ema_plain(x, p):
    out, prev = [None] * len(x), None
    for i, v in enumerate(x):
        if i == p - 1:
            prev = sum(x[:p]) / p
        elif i >= p:
            prev += (v - prev) * 2 / (p + 1)
        out[i] = prev
    return out


def wilder_plain(x, p):
    out, prev = [None] * len(x), None
    for i, v in enumerate(x):
        if i == p:
            prev = sum(x[1 : p + 1]) / p
        elif i > p:
            prev = (prev * (p - 1) + v) / p
        out[i] = prev
    return out


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (y is None and np.isnan(x)) or x == pytest.approx(y, rel=1e-9)


@pytest.mark.parametrize("n", [0, 1, 5, 14, 15, 40, 300])
def test_recursions(n):
    rng = random.Random(n)
    x = np.array([100 + rng.gauss(0, 5) for _ in range(n)])
    same(S.ema(x, 5), ema_plain(x.tolist(), 5))
    same(S.wilder(x, 14), wilder_plain(x.tolist(), 14))


def test_rsi_bounds():
    up = np.arange(1.0, 40)
    assert S.rsi(up)[-1] == 100 and S.rsi(up[::-1].copy())[-1] == 0 and np.isnan(S.rsi(up)[13])


def test_hash():
    assert S.fnv1a("") == 0x811C9DC5 and S.fnv1a("a") == 0xE40C292C


def test_rounding(spark):
    assert [to_fixed(x, 2) for x in (1.005, 2.675, 0.285)] == [1.0, 2.67, 0.28]
    r = spark.range(1).select(half_up(F.lit(-1.25), 1).alias("a"), half_up(F.lit(None).cast("double")).alias("b")).first()
    assert r.a == -1.2 and r.b is None


def bars(spark, closes, start=dt.date(2024, 1, 1), name=1):
    return spark.createDataFrame([(name, start + dt.timedelta(i), c, c * 1.01, c * 0.99, c, 1000.0) for i, c in enumerate(closes)], "instrument_id long, trade_date date, open double, high double, low double, close double, volume double")


def test_later_bars_do_not_change_earlier_ones(spark):
    rng = random.Random(5)
    closes = [100 + rng.gauss(0, 3) for _ in range(80)]
    short = S.indicators(bars(spark, closes[:60])).orderBy("trade_date").collect()
    assert S.indicators(bars(spark, closes)).orderBy("trade_date").collect()[:60] == short


def test_forward_return_enters_a_bar_later(spark):
    b = bars(spark, [106.0, 108.0, 110.0])
    got = [r.f for r in b.select("trade_date", S.forward_return(1).alias("f")).orderBy("trade_date").collect()]
    assert got[0] == pytest.approx(1.851851, abs=1e-5) and got[1:] == [None, None]


def test_bucket_sizes_differ_from_ntile(spark):
    x = spark.range(10).select(F.lit(1).alias("g"), "id")
    assert [r["count"] for r in x.select(X.bucket(["id"], ["g"], 4).alias("b")).groupBy("b").count().orderBy("b").collect()] == [3, 2, 3, 2]


@pytest.mark.parametrize(("sign", "want"), [(1, 1.0), (-1, -1.0)])
def test_perfect_and_inverted_scores(spark, sign, want):
    x = spark.range(300).select((F.col("id") % 6).alias("d"), F.col("id").cast("double").alias("s"), (sign * F.col("id")).cast("double").alias("f"))
    assert {r.ic for r in X.spearman(x, "s", "f", ["d"]).collect()} == {want}


def test_constant_score_has_no_correlation(spark):
    x = spark.range(20).select(F.lit(1).alias("d"), F.lit(2.0).alias("s"), F.col("id").cast("double").alias("f"))
    assert X.spearman(x, "s", "f", ["d"]).first().ic == 0


def test_newey_west_by_hand(spark):
    v = [0.1, -0.05, 0.2, 0.03, 0.07, -0.1, 0.15]
    r = X.series_summary(spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, d int, v double"), "v", "d", ["k"], lags=2).first()
    n, m = len(v), sum(v) / len(v)
    e = [x - m for x in v]
    s = sum(x * x for x in e) + sum(2 * (1 - k / 3) * sum(e[i] * e[i + k] for i in range(n - k)) for k in (1, 2))
    assert r.nw_t == pytest.approx(m / (s / n / n) ** 0.5)


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 40
    a, b, sec = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n)
    y = 2 * a - b + sec + rng.normal(size=n)
    df = spark.createDataFrame([(1, int(i), float(y[i]), float(a[i]), float(b[i]), int(sec[i])) for i in range(n)], "d int, i int, y double, a double, b double, s int")
    got = {r.i: r.residual for r in X.residuals(df, "y", ("a", "b"), "s", "d").collect()}
    m = np.column_stack([a, b, *(sec == k for k in range(3))]).astype(float)
    want = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist())
    assert all(r.residual is None for r in X.residuals(df.where("i < 5"), "y", ("a", "b"), "s", "d").collect())
