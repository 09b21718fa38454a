from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B

D = dt.date
LOG = "k int, valid date, known timestamp, value double, gone boolean"


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(day)


def test_later_corrections_do_not_change_an_earlier_view(spark):
    log = [(1, D(2024, 1, 1), at(1), 1.0, False), (1, D(2024, 1, 2), at(2), 2.0, False), (None, D(2024, 1, 1), at(1), 9.0, None), (1, D(2024, 1, 2), None, 7.0, False)]
    later = [(1, D(2024, 1, 1), at(5), 1.5, False), (1, D(2024, 1, 2), at(6), 2.0, True), (1, D(2023, 12, 31), at(6), 0.5, False), (2, D(2024, 1, 1), at(6), 3.0, None)]

    def seen(rows, day):
        x = B.view(spark.createDataFrame(rows, LOG), ["k", "valid"], "known", F.lit(at(day)), "valid", F.lit(D(2024, 1, 2)), "gone")
        return sorted((str(r.k), r.valid, r.value) for r in x.collect())

    assert seen(log, 4) == seen(log + later, 4) == [("1", D(2024, 1, 1), 1.0), ("1", D(2024, 1, 2), 2.0), ("None", D(2024, 1, 1), 9.0)]
    assert seen(log + later, 6) == [("1", D(2023, 12, 31), 0.5), ("1", D(2024, 1, 1), 1.5), ("2", D(2024, 1, 1), 3.0), ("None", D(2024, 1, 1), 9.0)]
    assert seen([], 6) == seen(log, 0) == []


def test_views_of_many_runs(spark):
    rng = random.Random(5)
    log = [(rng.randrange(3), D(2024, 1, 1) + dt.timedelta(rng.randrange(60)), at(rng.randrange(80), rng.randrange(24)), float(i), rng.random() < 0.1) for i in range(600)]
    runs = [(rng.randrange(4), at(rng.randrange(90), rng.randrange(24)), i) for i in range(120)]
    facts = B.versions(spark.createDataFrame(log, LOG), ["k", "valid"], "known")
    got = sorted((r.run, r.valid, r.value) for r in B.views(spark.createDataFrame(runs, "k int, at timestamp, run int"), facts, "k", "at", "valid", 10, "gone").collect())
    want = []
    for k, t, run in runs:
        newest = {}
        for key, valid, known, value, gone in log:
            if key == k and known <= t and t.date() - dt.timedelta(10) < valid <= t.date():
                newest[valid] = max(newest.get(valid, (known,)), (known, value, gone))
        want += [(run, valid, v[1]) for valid, v in newest.items() if not v[2]]
    assert got == sorted(want) and len(got) > 100
    assert B.versions(spark.createDataFrame([], LOG), ["k", "valid"], "known").count() == 0


def test_versions_at_one_moment(spark):
    x = spark.createDataFrame([(1, D(2024, 1, 1), at(1), 1.0, False)] * 2 + [(1, D(2024, 1, 1), at(1), 2.0, False), (1, D(2024, 1, 1), at(3), 0.0, False)], LOG)
    got = [(r.value, r.known_from, r.known_to) for r in B.versions(x, ["k", "valid"], "known", "value").orderBy("known_from").collect()]
    assert got == [(2.0, at(1), at(3)), (0.0, at(3), None)]
