"""Figures that must not grow faster than the input, told from plans and from small tables."""

from __future__ import annotations

import re

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.operators import cross as X
from tidemark.operators import grid as G
from tidemark.operators import series as S
from tidemark.plans import research_queries, strategy_queries

SF = f"{DATA}/sf0.001"


def shuffles(df) -> list[str]:
    """What rows are dealt by, once a shuffle, in the plan as it is before it runs."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_the_stack_deals_bars_once(spark):
    by = [re.sub(r"#\d+L?", "", x) for x in shuffles(strategy_queries.stack(spark, SF))]
    # Bars lie by instrument and are dealt by date; besides them three tables of a row a date move, and sectors.
    assert by.count("trade_date") <= 4 and by.count("instrument_id") <= 1 and len(by) <= 5, by


def test_known_bars_are_made_where_their_line_items_lie(spark):
    by = [re.sub(r"#\d+L?", "", x) for x in shuffles(strategy_queries.known_bars(spark, SF))]
    assert not [x for x in by if "trade_date" in x or "_w" in x], by


def test_news_along_rows_equal_news_joined(spark):
    known, bars = strategy_queries.known_bars(spark, SF), strategy_queries.bars_daily(spark, SF)
    want = {(r.instrument_id, r.trade_date): r.sentiment for r in strategy_queries.sentiments(spark, SF, bars).collect()}
    got = {(r.instrument_id, r.trade_date): r.sentiment for r in known.where("sentiment IS NOT NULL").collect()}
    assert got == want and len(set(got.values())) > 1


def test_rounded_labels_move_as_whole_numbers(spark):
    """Rounded labels go to their date as whole numbers."""
    plan = research_queries.cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression [trade_date") :].split("\n")[1]
    assert all(re.search(rf"excess{h}#\d+L", moved) for h in (1, 63)), moved


def test_cells_are_as_wide_as_a_bar(spark):
    c = research_queries.cells(spark, SF)
    assert c.groupBy("instrument_id", "trade_date").count().where("count > 1").count() == 0


def test_sums_of_a_date_equal_the_long_form(spark):
    rng = np.random.default_rng(5)
    rows = [(i, d, "abc"[i % 3], "BULL", *(None if rng.random() < 0.1 else float(v) for v in (rng.integers(0, 9), rng.normal(), rng.integers(-5, 5), rng.normal(), rng.normal()))) for d in range(4) for i in range(7 + 20 * d)]
    df = spark.createDataFrame(rows, "instrument_id long, d int, sector string, regime string, s double, a double, y1 double, b double, y2 double")
    ys = {("raw", 1): "y1", ("raw", 2): "y2"}
    got = G.rank_sums(df, ["s"], ys, "d", "instrument_id", 5, ["regime"], ("a", "b", "sector")).withColumn("ic", X.rank_correlation())
    got = {(r.d, r.label, r.h): (r.n, r.ic) for r in got.collect()}
    for h in (1, 2):
        want = X.spearman(df.withColumn("y", F.floor(F.col(f"y{h}") * 10000 + 0.5) / 10000), "s", "y", ["d"]).collect()
        res = X.residuals(df, f"y{h}", ("a", "b"), "sector", "d").where("residual IS NOT NULL").withColumn("y", F.floor(F.col("residual") * 100 + 0.5) / 100)
        assert {(r.d, "raw", h): (r.n, r.ic) for r in want} | {(r.d, "residual", h): (r.n, r.ic) for r in X.spearman(res, "s", "y", ["d"]).collect()} == {k: v for k, v in got.items() if k[2] == h}
    tenths = G.bucket_sums(df, ["s"], ys, "d", "instrument_id", 20, "a").where("h = 1")
    want = df.where("s IS NOT NULL AND y1 IS NOT NULL").withColumn("k", X.bucket(["s", "instrument_id"], ["d"], 10)).groupBy("d", "k").agg(F.count(F.lit(1)).alias("n")).join(df.where("s IS NOT NULL AND y1 IS NOT NULL").groupBy("d").count().where("count >= 20"), "d")
    assert {(r.d, r.decile, r.n) for r in tenths.collect()} == {(r.d, r.k, r.n) for r in want.collect()}


def test_signals_are_made_once(spark):
    from tidemark.plans import evaluation_queries as Q

    for q, most in ((Q.expectancy_interval, 12), (Q.slot_ranks, 3), (Q.slot_regret, 4)):
        by = shuffles(q(spark, SF))
        assert len(by) <= most, (q.__name__, by)


def test_draws_of_resamples_do_not_go_through_the_driver(spark):
    """The series is a small file, its draws are forty times as many rows: what is broadcast is a row a series at most."""
    from tidemark.operators import resampling

    df = spark.range(300).select(F.lit("a").alias("series"), F.expr("date_add(DATE '2024-01-01', int(id % 9))").alias("day"), "id", (F.col("id") % 7).alias("k"))
    plan = resampling.replicates(df, "series", "day", ["id"], ["k"], 400, 20, 1)._jdf.queryExecution().executedPlan().toString()
    joins = [(kind, re.sub(r"#\d+L?", "", by)) for kind, by in re.findall(r"(\w+Join) \[(.*?)\], \[", plan)]
    assert len(joins) == 3 and [by for kind, by in joins if kind.startswith("Broadcast")] == ["coalesce(_s, ), isnull(_s)"], joins


def test_cooled_signals_move_once_and_meet_nothing(spark):
    import datetime as dt

    from tidemark.operators import simulate as M
    from tidemark.operators import strategy as P

    rng = np.random.default_rng(6)
    days = {k: sorted(rng.choice(60, n, replace=False).tolist()) for k, n in ((1, 30), (2, 1), (3, 12))}
    rows = [(d + 0.5, dt.date(2024, 1, 1) + dt.timedelta(d), k, None if d % 3 else "x") for k, at in days.items() for d in rng.permutation(at).tolist()]
    kept = P.cooled(spark.createDataFrame(rows, "v double, at date, k int, s string"), "k", "at")
    assert len(shuffles(kept)) == 1 and "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    want = {(k, d) for k, at in days.items() for d, on in zip(at, M.cooled(np.array(at), 5).tolist(), strict=True) if on}
    assert {(r.k, (r.at - dt.date(2024, 1, 1)).days) for r in kept.collect()} == want and all(r.v == (r.at - dt.date(2024, 1, 1)).days + 0.5 and (r.s is None) == ((r.at - dt.date(2024, 1, 1)).days % 3 > 0) for r in kept.collect())


def test_bars_that_no_signal_can_come_of_carry_no_averages(spark):
    x = strategy_queries.signal_readings(spark, f"{DATA}/sf0.01")
    n = x.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in {"all": F.lit(True), "may": F.col("may"), "wide": F.col("may") | F.col("ema20").isNotNull() | F.col("atr14").isNotNull() | F.col("calm").isNotNull()}.items())).first()
    assert 0 < n.may == n.wide < n["all"] / 5, n
    may = x.where("may").select("instrument_id", "trade_date")
    assert strategy_queries.signals(spark, f"{DATA}/sf0.01").join(may, ["instrument_id", "trade_date"], "left_anti").count() == 0


def test_titles_of_frequent_words_do_not_all_meet(spark):
    import datetime
    import glob
    import os

    from tidemark.operators import titles
    from tidemark.sources.shared import shared_dir

    rng = np.random.default_rng(9)
    words = [f"w{i:02d}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 8), replace=False)), datetime.date(2024, 1, 1 + i % 9)) for i in range(500)]
    got = {(r.a, r.b): r.similarity for r in titles.similar_pairs(spark.createDataFrame(rows, "id long, title string, day date")).collect()}
    first = {}
    for i, t, d in rows:
        first.setdefault((t, d), i)
    one = [(i, d, set(t.split())) for (t, d), i in first.items()]
    want = {(i, j): len(x & y) / len(x | y) for i, d, x in one for j, e, y in one if i < j and abs((e - d).days) <= 3 and len(x & y) / len(x | y) >= 0.7}
    assert got == want and len(want) > 20
    keys = max(glob.glob(shared_dir(spark).removeprefix("file://") + "/titles-keys-*"), key=os.path.getmtime, default=None)
    assert keys
    meetings = spark.read.parquet(keys).groupBy("key").count().agg(F.sum(F.col("count") ** 2)).first()[0]
    assert meetings < 500 * 60, meetings


def sorts_by_date(df) -> list[str]:
    return [x for x in re.findall(r"Sort \[(.*?)\], false", df._jdf.queryExecution().executedPlan().toString()) if x.startswith("trade_date") and "sector" in x]


def test_ranks_of_a_date_sort_it_once_a_value(spark):
    assert len(sorts_by_date(strategy_queries.production_gates(spark, SF))) == 2
    assert len(sorts_by_date(strategy_queries.fundamental_scores(spark, SF))) == 1


def test_series_are_made_batch_by_batch(spark):
    """A task's series come in batches, not a group each; where a batch ends makes no difference."""
    from tidemark.operators import series as S

    rng = np.random.default_rng(3)
    rows = [(i, d, *map(float, sorted(rng.random(3)))) for i in (None, 1, 2, 3, 4) for d in rng.permutation(1 + 9 * (i or 3)).tolist()]
    df = spark.createDataFrame(rows, "instrument_id long, trade_date int, low double, close double, high double")
    assert "MapInArrow" in S.indicators(df)._jdf.queryExecution().executedPlan().toString()
    want, most = sorted(map(str, S.indicators(df).collect())), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert sorted(map(str, S.indicators(df).collect())) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    one = df.where("instrument_id = 4").orderBy("trade_date").toPandas()
    got = {r.trade_date: r.ema20 for r in S.indicators(df).where("instrument_id = 4").collect()}
    assert [got[d] for d in one.trade_date] == [None if v != v else float(v) for v in S.ema(one.close.to_numpy(), 20)]


def test_percentiles_equal_arrays_a_bar(spark):
    from tidemark.operators import factors as E
    from tidemark.operators import series as S

    v = np.random.default_rng(4).integers(0, 40, 700).astype(float)
    v[[0, 1, 5, 300]] = np.nan
    for rows in (64, 4096):
        got = S.mid_rank_of_last(v, 100, rows)
        for i in range(len(v)):
            f = v[max(0, i - 99) : i + 1]
            f = f[~np.isnan(f)]
            assert np.isnan(got[i]) if np.isnan(v[i]) else got[i] == ((f < v[i]).sum() + 0.5 * (f == v[i]).sum()) / len(f) * 100
    df = spark.createDataFrame([(1, i, None if x != x else x, 100.0) for i, x in enumerate(v.tolist())], "instrument_id long, trade_date int, atr14 double, close double")
    assert [r.p for r in df.select("trade_date", E.atr_percentile().alias("p")).orderBy("trade_date").collect()] == [None if x != x else x for x in S.mid_rank_of_last(v).tolist()]
    assert "collect_list" not in research_queries.atr_percentiles(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_parts_of_fundamentals_are_small(spark):
    plan = strategy_queries.fundamental_scores(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(instrument_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[0] == str(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_blocks_are_made_where_their_line_items_lie(spark):
    from tidemark.sources.market import bars_daily

    b = bars_daily(spark, SF, dealt=4, block=256)
    assert len(shuffles(b.groupBy("instrument_id", "_block").agg(F.collect_list("close")))) == 1
    plain = bars_daily(spark, SF)
    assert b.drop("_block").exceptAll(plain).count() == 0 and b.count() == plain.count()


def test_cells_write_and_move_no_more_than_they_read(spark):
    """Indicators and prices but the close are not written; what a bar's factors and ranks are made of does not go to its date beside them."""
    from tidemark.functions.numbers import half_up

    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        c = research_queries.cells(spark, SF)
        plan = c._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)
    names = lambda x: set(re.findall(r"(\w+)#\d+", x))
    moved = names(plan[plan.index("RepartitionByExpression [trade_date") :].split("\n")[1])
    made = [names(x) for x in re.findall(r"Relation spark_catalog\.\S+?\[(.*?)\]", plan)]
    assert made and not set.union(*made) & {"open", "high", "low", *S.INDICATORS}, made
    assert {"r60", "pe", "fwd63"} <= moved and not moved & {"close", "volume", "ttm", "before", "ema200"}, moved
    keys, nine = ["instrument_id", "trade_date"], research_queries._NINE
    want = strategy_queries.stack(spark, SF).where("ema200 IS NOT NULL")
    want = want.select(*keys, "sector", "regime", *((half_up(F.col(s), 3) if s in strategy_queries._SUBJECTS else F.col(s).cast("double")).alias(s) for s in nine))
    got = c.select(want.columns)
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0
