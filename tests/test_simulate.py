from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import simulate as M

FLAT = M.Exits(slippage=0.0, cost=0.0)


def run(o, h, l, c, stop, x=FLAT, broken=None):  # noqa: E741
    n = len(c)
    return M.trade(*(np.array(v, float) for v in (o, h, l, c)), np.arange(n), np.zeros(n, bool) if broken is None else np.array(broken), 0, stop, x)


def test_both_targets_on_one_day():
    end, net, why = run([100, 100, 100], [100, 100, 125], [100, 100, 100], [100, 100, 125], 95)
    assert (end, why) == (2, "target2") and net == pytest.approx(0.5 * 10 + 0.5 * 15)


def test_stop_fills_at_its_price_on_a_gap():
    assert run([100, 100, 80], [100, 100, 82], [100, 100, 79], [100, 100, 81], 95)[1:] == (pytest.approx(-5), "stop")


def test_after_the_first_target_the_stop_is_the_entry():
    end, net, why = run([100, 100, 100, 104], [100, 100, 111, 105], [100, 100, 100.5, 99], [100, 100, 110, 100], 95)
    assert (end, why) == (3, "stop") and net == pytest.approx(5)


def test_time_thesis_end_and_no_entry():
    flat = [100.0] * 12
    assert run(flat, flat, flat, flat, 90)[0::2] == (8, "time")
    assert run(flat, flat, flat, flat, 90, broken=[False] * 3 + [True] * 9)[2] == "thesis"
    assert run(flat[:4], flat[:4], flat[:4], flat[:4], 90)[2] == "end"
    assert run([1.0], [1.0], [1.0], [1.0], 0.5) is None


def test_cooldown_counts_from_the_last_that_stayed():
    assert M.cooled(np.array([0, 3, 5, 9, 10]), 5).tolist() == [True, False, True, False, True]


def test_folds_leave_an_embargo(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(40)], "trade_date date")
    f = M.folds(cal, 3, 2).orderBy("fold").collect()
    assert [(r.test_from - r.train_to).days for r in f] == [3, 3, 3] and f[-1].test_to == dt.date(2024, 2, 9)


def test_book_keeps_its_slots(spark):
    d = dt.date(2024, 1, 1)
    t = spark.createDataFrame([("c", i, d, d, d + dt.timedelta(5), 10.0, "time") for i in range(4)], M.TRADES)
    first, last = M.book(t, slots=2, cash=1000.0, share=0.2).orderBy("trade_date").collect()
    assert (first.taken, first.skipped, first.open_slots) == (2, 2, 0) and last.equity == pytest.approx(1040)


def test_queries_simulate_daily_bars_on_the_reference_s_grid(spark):
    from conftest import DATA
    from tidemark.plans import sim_queries as Q
    from tidemark.sources.market import bars_daily

    assert [(x.days, x.target1, x.target2) for x in Q.CONFIGS] == [(d, a, b) for d in (7, 14, 21, 30) for a, b in ((1.5, 2.5), (2, 3), (2, 4), (3, 5))]
    assert len({x.name for x in Q.CONFIGS}) == 16
    sf = f"{DATA}/sf0.001"
    bars, signals = bars_daily(spark, sf).toPandas(), Q.signals(spark, sf).toPandas()
    assert len(signals) == len(bars) and set(zip(signals.instrument_id, signals.trade_date)) == set(zip(bars.instrument_id, bars.trade_date))
    done = Q.simulated_trades(spark, sf).toPandas()
    exits = {d: set(map(tuple, done[done.config == f"d{d}-t2-3"][["instrument_id", "signal_date", "exit_date"]].to_numpy())) for d in (7, 14)}
    assert exits[7] and exits[7] != exits[14]  # on monthly bars both end at the next bar


def test_generator_and_bootstrap(spark):
    g = M.mulberry32(7)
    x = [g() for _ in range(2000)]
    assert all(0 <= v < 1 for v in x) and abs(sum(x) / len(x) - 0.5) < 0.03 and x[:2] == [(h := M.mulberry32(7))(), h()]
    s = spark.createDataFrame([("a", i, 1.0) for i in range(30)], "k string, d int, v double")
    assert M.stationary_bootstrap(s, "v", "d", "k", reps=20).first()[1:] == (1.0, 1.0, 1.0)


def test_the_bootstrap_query_draws_as_the_reference(spark, monkeypatch):
    from conftest import DATA
    from tidemark.plans import sim_queries as Q

    seen = {}
    monkeypatch.setattr(M, "stationary_bootstrap", lambda *a, **b: seen.update(b))
    Q.bootstrap_ic(spark, f"{DATA}/sf0.001")
    assert seen == {"reps": 10_000, "block": 20, "seed": 12345}


def test_split_moves_what_came_before(spark):
    b = spark.createDataFrame([(1, dt.date(2024, 1, 1 + i), p, p, p, p, 10.0) for i, p in enumerate([100.0, 100.0, 50.0])], "instrument_id long, trade_date date, open double, high double, low double, close double, volume double")
    got = M.split_adjusted(b).orderBy("trade_date").collect()
    assert [r.close for r in got] == pytest.approx([50, 50, 50]) and [r.volume for r in got] == pytest.approx([20, 20, 10])


def test_the_book_is_read_once_in_order(spark):
    rng = np.random.default_rng(4)
    d0 = np.datetime64("2024-01-01")
    rows = []
    for c in "ab":
        for k in range(120):
            e = int(rng.integers(0, 60))
            rows.append((c, k, *(str(d0 + x) for x in (e - 1, e, e + int(rng.integers(0, 9)))), float(rng.normal(0, 5))))
    done = spark.createDataFrame(rows, "config string, instrument_id long, s string, e string, x string, net double").selectExpr("config", "instrument_id", "date(s) AS signal_date", "date(e) AS entry_date", "date(x) AS exit_date", "net", "'time' AS reason")
    want = []
    for c in "ab":
        money, held = 100_000.0, []
        own = sorted((r[3], r[1], r[4], r[5]) for r in rows if r[0] == c)
        for d in sorted({r[0] for r in own} | {r[2] for r in own}):
            taken = skipped = 0
            for _, _, out, net in (r for r in own if r[0] == d):
                size = min(money, 0.2 * (money + sum(h[1] for h in held)))
                if len(held) < 5 and size > 0:
                    held.append((out, size, net))
                    money, taken = money - size, taken + 1
                else:
                    skipped += 1
            for h in [h for h in held if h[0] <= d]:
                money = round(money + h[1] * (1 + h[2] / 100), 2)
                held.remove(h)
            want.append((c, d, money + sum(h[1] for h in held), money, 5 - len(held), taken, skipped))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        book = M.book(done)
        assert sorted((r[0], str(r[1]), *r[2:]) for r in book.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in book._jdf.queryExecution().executedPlan().toString()  # which would hold a configuration whole
