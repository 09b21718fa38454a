from __future__ import annotations

import datetime as dt
import struct

from pyspark.sql import functions as F

from tidemark.functions import strings
from tidemark.functions.strings import canonical_symbol, fallback_available, jaccard, matches_all, normal_title, number, title_tokens
from tidemark.operators import asof, orders, titles
from tidemark.sources import files
from tidemark.streaming import flows


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first())


def test_strings(spark):
    L = F.lit
    assert one(spark, canonical_symbol(L(" abc-EQ ")), number(L("₹ 1,23,456.5")), number(L("n/a")), normal_title(L("  A&B -- wins!! ")), title_tokens(L("The big Order of x big"))) == ("ABC", 123456.5, None, "a&b wins", ["big", "order"])
    assert one(spark, jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c"))), matches_all(L("NIFTY 24500 CE"), "nifty24500ce")) == (1 / 3, True)
    assert one(spark, fallback_available(L(dt.date(2024, 3, 31))), fallback_available(L(dt.date(2024, 6, 30)))) == (dt.date(2024, 5, 30), dt.date(2024, 8, 14))


def test_daily_file(spark):
    text = ["SYMBOL, SERIES, DATE1", "ABC, EQ, 05-Jan-2024, 10, 11, 12, 10, 11, 11.5, 11, 1000, 5, 20, 400, 40.0\r", "ABC, BE, 05-Jan-2024, 10, 11, 12, 10, 11, 11.5, 11, 1, 5, 2, 4, 40", "X, EQ", "ABC, EQ, 05-Foo-2024, 10, 11, 12, 10, 11, 11.5, 11, 1, 5, 2, 4, 40", "P, EQ, 05-Jan-2024, -, 11, 10, 12, 11, 11.5, 11, 1, 5, 2, -, -", "D, EQ, 05-JAN-2024, -, 11, 12, 10, 11, 11.5, 11, -, 5, 2, 4, 140"]
    r = files.daily_file(spark.createDataFrame([(t,) for t in text], "value string")).collect()
    assert [x.reason for x in r] == [None, "series", "short", "date", "price", "delivered"]
    assert (r[0].symbol, r[0].trade_date, r[0].delivered_pct, r[0].prev_close) == ("ABC", dt.date(2024, 1, 5), 40.0, 10.0) and r[5].prev_close == 11.5 and r[5].volume == 0


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A &amp; <b>B</b>]]></title><link>http://x/1</link><pubDate>d1</pubDate></item><item><title></title></item></rss>"
    atom = '<feed><entry><title>C</title><link rel="self" href="http://s"/><link rel="alternate" href="http://y/2"/><updated>d2</updated></entry></feed>'
    r = files.feed_items(spark.createDataFrame([("s", rss), ("t", atom), ("u", None), ("v", "junk")], "source string, payload string")).orderBy("source").collect()
    assert [tuple(x) for x in r] == [("s", "A & B", "http://x/1", "d1"), ("t", "C", "http://y/2", "d2")]
    j = files.announcements(spark.createDataFrame([('{"Table":[{"SLONGNAME":"Abc","MORE":"m","HEADLINE":"H &amp; I","NEWS_DT":"2024-01-05T10:00:00","SCRIP_CD":"5"}]}',), ('"No Record Found!"',), ("{bad",)], "payload string")).collect()
    assert [(x.scrip, x.title, x.body, x.published) for x in j] == [("5", "H & I", "Abc — m", dt.datetime(2024, 1, 5, 10))]
    a = files.archive_records(spark.createDataFrame([('{"date":"20240105T101500Z","url":"u","domain":"X.IN","title":"A , b"}',), ("oops",), ('{"date":"20241305T101500Z","url":"w"}',)], "value string"))
    assert [(x.url, x.domain, x.title, x.seen) for x in a.orderBy("url").collect()] == [("u", "x.in", "A, b", dt.datetime(2024, 1, 5, 10, 15)), ("w", None, None, None)]
    assert files.first_seen(a.union(a), spark.createDataFrame([("w",)], "url string")).count() == 1


def test_ticks(spark):
    raw = bytearray(347)
    raw[2:7] = b"26009"
    struct.pack_into("<q", raw, 43, 12345)
    struct.pack_into("<q", raw, 67, 99)
    struct.pack_into("<hqq", raw, 147, 1, 5, 12340)
    struct.pack_into("<hqq", raw, 167, 0, 0, 12350)
    r = files.ticks(spark.createDataFrame([(bytes(raw),), (b"x",), (None,)], "frame binary")).collect()
    assert [tuple(x) for x in r] == [("26009", 123.45, 99, 123.4, 123.45)]


def test_cohort_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([("1", "A", "x"), ("1", "B", "y"), ("2", "A", "z"), ("2", "C", "q"), ("3", "A", "z")], "label string, symbol string, sector string")
    assert {tuple(r) for r in files.cohort(s, "1").collect()} == {("A", "z", None), ("B", "y", "2")}
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, v double")
    files.write_report(df, str(tmp_path / "r"), ["k"])
    assert next((tmp_path / "r").glob("*.csv")).read_text().split() == ["k,v", "1,", "2,1.5"]
    for _ in range(2):
        files.append_run(df, str(tmp_path / "runs"), "a")
    files.append_run(df, str(tmp_path / "runs"), "b")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4


def test_titles(spark):
    d = dt.date(2024, 1, 1)
    t = spark.createDataFrame([(1, "Acme wins big order today", d), (2, "Acme WINS big order, today!", d), (3, "Acme wins big order now", d + dt.timedelta(30)), (4, "", d), (5, "--", d), (6, "the", d), (7, "The", d)], "id long, title string, day date")
    p = titles.similar_pairs(t)
    assert p.count() == 0 and {r.id: r.cls for r in titles.title_classes(t).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    kept = {r.id: r.kept for r in titles.accept_in_order(t, p).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}
    e = lambda x, b=None: one(spark, *(titles.event_type(F.lit(x), F.lit(b))[k] for k in ("kind", "method")))
    assert [e("Company bags order worth 5 crore"), e("Board Meeting on dividend"), e("x", "(LODR)-Credit Rating"), e(None), e("wins order", "Reg 30 (LODR)-Something new")] == [("ORDER_WIN", "keyword"), ("DIVIDEND", "keyword"), ("RATING_ACTION", "exchange-label"), ("OTHER", "none"), ("OTHER", "exchange-label")]
    assert [e("Trading Window closure, insider trading rules")[0], e("Disclosure under insider trading rules")[0], e("Transfer of shares")[0], e("Sale of its subsidiary")[0]] == ["TRADING_WINDOW", "INSIDER_PLEDGE", "OTHER", "M_AND_A"]
    assert one(spark, titles.named_symbols(F.lit("Tata  Steel and Tata Power"), [("TS", "tata steel", None), ("T", "tata", "power"), ("N", "ata", None)]))[0] == ["TS", "T"]


def test_titles_are_accepted_in_order(spark):
    """Against the loop that compares each title with all accepted ones before it."""
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(25)]
    base = [[rng.choice(words) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(6)] = rng.choice(words)
        rows.append((i, " ".join(w) if i % 30 else "", dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(12))))
    want, accepted = {}, []
    for i, text, day in sorted(rows, key=lambda r: (r[2], r[0])):
        t = set(text.split())
        alike = any(text and (text == u or len(t & v) >= 0.7 * len(t | v)) and abs((day - d).days) <= 3 for u, v, d in accepted)
        want[i] = not alike
        if not alike:
            accepted.append((text, t, day))
    assert not all(want.values())
    df = spark.createDataFrame(rows, "id long, title string, day date")
    assert {r.id: r.kept for r in titles.accept_in_order(df, titles.similar_pairs(df)).collect()} == want


def test_domains_sectors_and_units(spark):
    L = F.lit
    domains = ("india.com", "economictimes.indiatimes.com")
    of = lambda u: one(spark, strings.of_domains(strings.site(L(u)), domains))[0]
    assert [of(u) for u in ("https://www.india.com/x", "http://auto.economictimes.indiatimes.com:443?q", "xindia.com", "https://a.co.in/", "in", "", "indiatimes.com")] == [True, True, False, True, True, False, False]
    assert one(spark, strings.sector_name(L(" pharma ")), strings.sector_name(L(" Mining "))) == ("Healthcare", "Mining")
    w = lambda x: one(spark, strings.western_units(L(x)))[0]
    cases = {
        "Rs 1,200 crore profit": "INR 12.00 billion profit", "₹450 crore order win": "INR 4.50 billion order win", "Rs. 45 cr penalty": "INR 450.00 million penalty", "5 lakh shares": "0.50 million shares",
        "profit in crores": "profit in tens of millions", "lakhs of investors": "hundreds of thousands of investors", "PAT up 20% YoY": "net profit up 20% year-on-year", "margin down 150 bps QoQ": "margin down 150 basis points quarter-on-quarter",
        "gross NPAs decline": "gross bad loans decline", "Q1FY26 results": "Q1 fiscal year 26 results", "guidance for FY 2027": "guidance for fiscal year 2027", "Pat said profits across sectors": "Pat said profits across sectors",
        "  Rs   10 crore   PAT  ": "INR 100.00 million net profit", "2 crore and 3 lakh and 4 crore": "20.00 million and 0.30 million and 40.00 million", "": "",
    }
    assert {k: w(k) for k in cases} == cases


def test_asof_edges(spark):
    L = spark.createDataFrame([(1, dt.date(2024, 1, 10)), (1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 5))], "k long, at date")
    R = spark.createDataFrame([(1, dt.date(2024, 1, 10), 5.0), (1, dt.date(2024, 1, 2), 3.0)], "k long, d date, v double")
    got = {(r.k, r.at.day): r.v for r in asof.last_before(L, R, "k", "at", "d", "v").collect()}
    assert got == {(1, 10): 5.0, (1, 1): None, (2, 5): None}
    after = {(r.k, r.at.day): (r.anchor_date and r.anchor_date.day, r.v) for r in asof.first_after(L, R, "k", "at", "d", ["v"]).collect()}
    assert after == {(1, 10): (None, None), (1, 1): (2, 3.0), (2, 5): (None, None)}
    q = spark.createDataFrame([(1, dt.date(2024, 3, 31), 1.0, dt.date(2024, 5, 1))], "k long, period_end date, eps double, available_at date")
    d = spark.createDataFrame([(1, dt.date(2024, 5, 1)), (1, dt.date(2024, 5, 2))], "k long, as_of date")
    assert [r.as_of.day for r in asof.trailing_quarters(q, d, "k").collect()] == [2]


def test_orders(spark):
    p = orders.charges(F.lit(100000.0), F.lit(False))
    assert one(spark, p["stt"], p["total"]) == (150.0, 150 + 35.03 + 0.100952 + 20 + (35.03 + 20) * 0.18)
    lp = lambda buy, b, a, x: round(one(spark, orders.limit_price(F.lit(buy), F.lit(b).cast("double"), F.lit(a).cast("double"), F.lit(x).cast("double"), F.lit(0.05)))[0], 2)
    assert [lp(True, 99.0, 99.5, 99.2), lp(False, 0.1, 0.2, 0.1), lp(True, None, None, 250.0)] == [99.75, 0.05, 251.0]


def test_streams_settle_to_their_batch(spark, tmp_path):
    rows = [(1, "PENDING", 0.0, 1), (1, "OPEN", 0.0, 2), (1, "OPEN", 0.0, 2), (1, "COMPLETED", 5.0, 3), (1, "OPEN", 0.0, 4), (2, "COMPLETED", 1.0, 1)]
    df = spark.createDataFrame(rows, "order_id long, status string, filled double, seq long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = flows.order_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = flows.to_batches(stream, lambda b, _: seen.update({r.order_id: tuple(r)[1:] for r in b.collect()}), str(tmp_path / "cp")).outputMode("update").start()
    q.awaitTermination(120)
    assert seen == {1: ("COMPLETED", 5.0, 3, 2), 2: ("", 0.0, 0, 1)}


def test_last_values_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 1.0, 1), (1, t + dt.timedelta(seconds=1), 2.0, 2), (2, t, 3.0, 3), (2, t, 4.0, 4)], "user_id long, ts timestamp, value double, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    flows.to_batches(flows.last_values(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), lambda b, _: seen.update({r.user_id: r.value for r in b.collect()}), str(tmp_path / "cp")).outputMode("update").start().awaitTermination(120)
    assert seen == {1: 2.0, 2: 4.0} == {r.user_id: r.value for r in flows.last_values(df).collect()}


def test_repeated_articles_are_dropped(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(hours=1)), ("v", t)], "url string, fetched_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    flows.to_batches(flows.new_articles(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["url"]), lambda b, _: got.extend(r.url for r in b.collect()), str(tmp_path / "cp")).start().awaitTermination(120)
    assert sorted(got) == ["u", "v"]


def test_hooks(spark):
    from tidemark.operators import plugins as P

    bars = spark.createDataFrame([(1, 10.0), (2, 90.0)], "id long, close double")
    reg = P.Factors().add(P.ColumnFactor("half", lambda: F.col("close") / 2)).add(P.ColumnFactor("full", lambda: F.col("close")))
    assert [tuple(r) for r in reg.evaluate(bars).orderBy("id").collect()] == [(1, 10.0, 5.0, 10.0, -0.9, -0.8), (2, 90.0, 45.0, 90.0, -0.1, 0.8)]
    try:
        reg.add(P.ColumnFactor("half", lambda: F.lit(1.0)))
        raise AssertionError
    except ValueError:
        pass
    stats = P.summarise(bars, [], lambda: F.col("close"), lambda: F.col("id"), {"dot": lambda s, y: F.sum(s * y), "n": lambda s, y: F.count(s)}).first()
    assert tuple(stats) == (190.0, 2)


def test_texts_are_scored_in_batches(spark):
    from tidemark.operators import plugins as P

    news = spark.createDataFrame([(k, t) for k, t in enumerate(["record profit", "fraud and loss", "gain loss", None, "plain"])], "id long, title string")
    got = {r.id: (r.score, r.neutral) for r in P.scored(news, batch=2).collect()}
    assert got == {0: (1.0, 1 / 3), 1: (-1.0, 1 / 3), 2: (0.0, 1 / 3), 3: (0.0, 1.0), 4: (0.0, 1.0)}

    def broken():
        def f(texts):
            if "plain" in texts:
                raise RuntimeError
            return [(0.5, 0.0)] * len(texts)

        return f

    first = P.scored(news.coalesce(1), broken, "b-1", batch=1)
    assert {r.id: r.score for r in first.collect()} == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5, 4: None}
    again = {r.id: (r.score, r.model) for r in P.scored(first, version="b-1").collect()}
    assert again == {0: (0.5, "b-1"), 1: (0.5, "b-1"), 2: (0.5, "b-1"), 3: (0.5, "b-1"), 4: (0.0, "b-1")}


def test_announcement_shapes(spark):
    xml = '<X><table id="1"><HEADLINE> </HEADLINE><NEWSSUB>Sub &lt;1&gt;</NEWSSUB><SLONGNAME>Abc</SLONGNAME></table><Table><MORE>no headline</MORE></Table></X>'
    rows = [
        (1, ' [{"NEWSSUB":"S","HEADLINE":"","DT_TM":"x","ATTACHMENTNAME":"a.pdf","MORE":null}, 7]'), (2, xml), (3, "<rss><item><title>T</title><guid>http://g</guid></item></rss>"),
        (4, None), (5, ""), (6, '{"Table":null}'), (7, '{"Other":1}'), (8, "{bad"), (9, '"No Record Found!"'), (10, "<Table>"),
    ]
    got = [tuple(r) for r in files.announcements(spark.createDataFrame(rows, "id int, payload string")).orderBy("id").collect()]
    assert got == [(1, None, "S", "S", files.ATTACHMENTS + "a.pdf", None), (2, None, "Sub <1>", "Abc — Sub <1>", "", None), (3, None, "T", None, "http://g", None)]
    assert files.announcements(spark.createDataFrame([], "id int, payload string")).count() == 0


def test_failed_windows_are_not_empty_ones(spark):
    ok = '{"articles":[{"url":" u ","title":"Up 2 , 200 % &amp; more","seendate":" 20240229T235959Z "},{"url":"v","title":"x","seendate":"20230229T000000Z"},{"url":"w","title":"x","seendate":"20240101T239900Z"},{"url":3,"title":"x","seendate":"20240101T000000Z"},5,null]}'
    rows = [(1, ok), (2, "{}"), (3, '{"articles":[]}'), (4, "<html>"), (5, None), (6, '"text"'), (7, ""), (8, '{"articles":{"a":1}}'), (9, "[1]")]
    x = spark.createDataFrame(rows, "win int, payload string")
    assert [tuple(r) for r in files.archive_windows(x).orderBy("win").collect()] == [(1, "ok", 6), (2, "empty", 0), (3, "empty", 0), (4, "failed", 0), (5, "failed", 0), (6, "empty", 0), (7, "failed", 0), (8, "empty", 0), (9, "empty", 0)]
    got = [tuple(r) for r in files.archive_articles(x, latency_minutes=15).collect()]
    assert got == [(1, "u", "Up 2, 200% & more", "", dt.datetime(2024, 2, 29, 23, 59, 59), dt.datetime(2024, 3, 1, 0, 14, 59))]


def test_first_seen_by_source(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("a", "u", "x", t), ("b", "u", "y", t), ("b", "u", "z", t + dt.timedelta(1)), ("b", "v", "q", None)], "source string, url string, title string, seen timestamp")
    known = spark.createDataFrame([("a", "u")], "source string, url string")
    assert sorted((x.source, x.url, x.title) for x in files.first_seen(r, known, ("source", "url")).collect()) == [("b", "u", "y"), ("b", "v", "q")]


def test_ticks_against_one_by_one(spark):
    import random

    rng, frames, want = random.Random(3), [], []
    for n in [*rng.choices(range(40, 380), k=150), 51, 74, 75, 166, 167, 347]:
        raw = bytearray(rng.randbytes(n))
        if n >= 51:
            struct.pack_into("<q", raw, 43, rng.randrange(-(10**9), 10**9))
        raw[2:27] = f"t{n}\0".encode().ljust(25, b"\0")[: len(raw[2:27])]
        for k in range(10):
            if len(raw) >= 167 + 20 * k:
                struct.pack_into("<hqq", raw, 147 + 20 * k, rng.choice([0, 1, 1, 2]), rng.choice([0, -1, 5]), rng.choice([0, -3, 100 + k]))
        frames.append((bytes(raw),))
        if n >= 51:
            ltp, side = struct.unpack_from("<q", raw, 43)[0] / 100, {}
            for at in range(147, len(raw) - 19, 20):
                s, q, p = struct.unpack_from("<hqq", raw, at)
                if at < 347 and q > 0 and p > 0:
                    side.setdefault(s, p / 100)
            want.append((f"t{n}", ltp, struct.unpack_from("<q", raw, 67)[0] if n >= 75 else 0, side.get(1, ltp), side.get(0, ltp)))
    assert sorted(tuple(r) for r in files.ticks(spark.createDataFrame(frames, "frame binary")).collect()) == sorted(want)
