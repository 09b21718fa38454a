from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, ingest, titles
from tidemark.sources import company_pages as C
from tidemark.streaming import alerts, flows

PAGE = """<a href="https://www.bseindia.com/stock-share-price/abc-ltd/abc/512345/">BSE</a>
<li class="flex"><span class="name"> Market Cap </span><span class="number">1,23,456.5</span> Cr.</li>
<li class="flex"><span class="name">High / Low</span><span class="number">-</span> / <span class="number">12</span></li>
<li class="flex"><span class="name">None</span></li>
<section id="quarters"><table><tr><th></th><th> Jun 2023 </th><th class="x">September 2023</th><th>Feb 2024</th></tr>
<tr class="a"> <td class="text">Sales&nbsp;<b>+</b></td><td>9</td><td>1,000</td><td>-</td><td>3</td></tr>
<tr> <td class="text">Net Profit</td><td>-2.5</td><td>x</td></tr>
<tr> <td class="text"> EPS in Rs </td><td>0</td><td>1.5</td><td></td><td>2.25</td></tr></table></section>"""


def test_company_page(spark):
    pages = spark.createDataFrame([(1, PAGE, "z"), (2, None, "z"), (3, "<html>nothing", "z"), (4, PAGE.replace("EPS", "E P S"), "z")], "i int, html string, period_end string")
    got = [tuple(r) for r in C.quarters(pages, "i").orderBy("period_end").collect()]
    # "September 2023" is no header of three letters; the empty rest behind the last cell counts, so the last two cells are 2.25 and the rest, and two numbers of the profit are too early.
    assert got == [(1, dt.date(2023, 6, 30), 2.25, None, 3.0)]
    assert [tuple(r) for r in C.ratios(pages.where("i = 1"), "i").orderBy("place").collect()] == [(1, 0, "Market Cap", 123456.5), (1, 1, "High / Low", 12.0)]
    assert [r[0] for r in pages.orderBy("i").select(C.exchange_code(F.col("html"))).collect()] == ["512345", None, None, "512345"]
    assert C.quarters(pages.limit(0), "i").count() == 0


def test_month_labels(spark):
    labels = ["Jun 2026", " Mar 2024", "Feb 2024", "february 2023", "DEC 1999", "garbage", "Foo 2020", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").orderBy("i").select(C.month_end(F.col("x"))).collect()]
    assert got == [dt.date(2026, 6, 30), dt.date(2024, 3, 31), dt.date(2024, 2, 29), dt.date(2023, 2, 28), dt.date(1999, 12, 31), None, None, None, None]


def reports(sources, runs):
    out, before = [], None
    for run, at, degraded in runs:
        own = {s: (e, p, n) for r, s, e, p, n in sources if r == run}
        found = []
        for s, (e, p, n) in own.items():
            b = before and before[0].get(s)
            if e is not None:
                if b and b[0] is not None:
                    found.append(f"failed:{s}:{e}")
                continue
            if n is not None and n < at - dt.timedelta(3):
                found.append(f"frozen:{s}:{n:%Y-%m-%d}")
            if p == 0 and b and b[0] is None and b[1] == 0:
                found.append(f"empty:{s}")
        if degraded and before and before[1]:
            found.append("scoring")
        failures = sum(e is not None for e, _, _ in own.values())
        status = "failed" if own and failures == len(own) else "degraded" if failures or found or degraded else "ok"
        out.append((run, status, sorted(found), sorted(a for a in found if not before or a not in before[2])))
        before = own, degraded, found
    return out


def test_ingest_reports(spark):
    rng = random.Random(4)
    runs = [(i, dt.datetime(2024, 1, 1, 8) + dt.timedelta(hours=6 * i), rng.random() < 0.4) for i in range(40)]
    sources = [(i, s, rng.choice([None, None, "503"]), rng.choice([0, 0, 5]), rng.choice([None, at, at - dt.timedelta(3), at - dt.timedelta(3, 1)])) for i, at, _ in runs for s in "abc" if rng.random() < 0.8 and i != 7]
    got = ingest.source_alerts(spark.createDataFrame(sources, "run int, source string, error string, parsed int, newest timestamp"), spark.createDataFrame(runs, "run int, fetched_at timestamp, degraded boolean"))
    assert [(r.run, r.status, r.alerts, sorted(r.new_alerts)) for r in got.orderBy("run").collect()] == reports(sources, runs)


@pytest.mark.parametrize("files", [1, 4])
def test_near_duplicates_of_a_stream_are_those_of_the_table(spark, tmp_path, files):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    base = [" ".join(rng.sample(words, rng.randint(4, 8))) for _ in range(12)]
    rows = []
    for i in range(80):
        t = rng.choice(base).split()
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join([*t, f"n{i % 60}"]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=4 * i + rng.randint(0, 3))))
    schema = "id long, title string, at timestamp"
    whole = spark.createDataFrame(rows, schema)
    want = {(r.a, r.b, round(r.similarity, 9)) for r in titles.similar_pairs(whole.select("id", "title", F.to_date("at").alias("day"))).collect()}
    days = {i: at for i, _, at in rows}
    want = {w for w in want if abs(days[w[0]] - days[w[1]]) <= dt.timedelta(3)}
    assert len(want) > 5 and {(r.a, r.b, round(r.similarity, 9)) for r in flows.similar_articles(whole).collect()} == want
    for k in range(files):
        whole.where(F.floor(F.col("id") * files / 80) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.similar_articles(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_alerts_are_tried_again_and_sent_anew(spark, tmp_path):
    store, now = str(tmp_path / "store"), dt.datetime(2024, 1, 1)
    rows = [(str(i), now + dt.timedelta(minutes=i), ("bad " if i % 2 else "good ") + str(i)) for i in range(50)]
    batch = spark.createDataFrame(rows, "id string, created_at timestamp, text string").repartition(3)

    def send(text):
        if text.startswith("bad"):
            raise OSError("no route")

    quiet = {"sleep": lambda s: None}
    write = alerts.sink(send, store, **quiet)
    write(batch, 0)
    write(batch, 0)  # a batch that is run again
    got = spark.read.schema(alerts.OUTCOME).parquet(store).collect()
    assert len(got) == 50 and all((r.ok, r.attempts, r.error) == ((True, 1, None) if r.text.startswith("good") else (False, 3, "no route")) for r in got)
    assert alerts.resend(spark, store, send, **quiet) == 0 and alerts.undelivered(spark, store).count() == 25
    assert alerts.resend(spark, store, lambda text: None, **quiet) == 20
    assert sorted(int(r.id) for r in alerts.undelivered(spark, store).collect()) == [41, 43, 45, 47, 49]  # the oldest went first
    assert alerts.resend(spark, store, lambda text: None, **quiet) == 5 and alerts.undelivered(spark, store).count() == 0


def test_waits_between_tries():
    waited = []

    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            return list(run(iter([pd.DataFrame({"id": ["1"], "created_at": [None], "text": ["x"]})])))

    def send(text):
        raise OSError("down")

    from unittest import mock

    with mock.patch.object(alerts.F, "col"):
        out = alerts.sent(Rows(), send, sleep=waited.append)[0]
    assert waited == [1.0, 2.0] and not out.ok[0] and out.attempts[0] == 3


@pytest.mark.parametrize(("total", "n", "warmup", "embargo", "first"), [(50, 3, 5, 4, 20), (9, 3, 5, 0, 5), (7, 3, 5, 0, 6), (50, 1, 0, 60, 61), (30, 4, 0, 2, 3)])
def test_folds_by_place(spark, total, n, warmup, embargo, first):
    days = [dt.date(2024, 1, 1) + dt.timedelta(3 * i) for i in range(total)]
    calendar = spark.createDataFrame([(d,) for d in days], "trade_date date")

    def window(a, b):
        own = days[a:b]
        return (own[0], own[-1], len(own)) if own else (None, None, 0)

    for got, at, size, ok in ((folds.expanding(calendar, n, warmup, embargo), warmup + (total - warmup) // (n + 1), (total - warmup) // (n + 1), True), (folds.anchored(calendar, n, first, warmup, embargo), first, (total - first) // n, first > warmup + embargo)):
        want = [(i + 1, *window(warmup, max(warmup, at + size * i - embargo)), *window(at + size * i, total if i == n - 1 else at + size * (i + 1))) for i in range(n)] if ok and size > 0 else []
        assert [tuple(r) for r in got.orderBy("fold").collect()] == want


def test_the_cut_of_a_day_reaches_the_scan(spark):
    from tidemark.sources.market import bars_daily

    plan = bars_daily(spark, "/root/testdata/sf0.001", "1995-06-30")._jdf.queryExecution().toString()
    assert "LessThan(l_shipdate" in plan
