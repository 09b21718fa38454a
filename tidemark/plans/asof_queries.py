"""What was known when: events on bars, news, results, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.strings import fallback_available
from ..operators import asof as A
from ..operators import cross as X
from ..operators import series as S
from ..sources.market import SQL_BARS, SQL_BENCH, bars_daily, benchmark, table
from ..sources.shared import written
from .registry import query, r
from .series_queries import KEYS, W

# Events fall in 30 days of their own; they are laid over the bars' years, a day of theirs for 80 of the bars'.
_EV = """ev AS (SELECT event_id, 1 + user_id % (SELECT max(l_suppkey) FROM lineitem) AS instrument_id, event_type,
  CAST((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + CAST(80 * date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS DATE) AS at FROM events)"""


def events_on_bars(spark, sf) -> DataFrame:
    e, li = table(spark, sf, "events"), table(spark, sf, "lineitem")
    one = li.agg(F.max("l_suppkey").alias("m"), F.min(F.to_date("l_shipdate")).alias("d0")).crossJoin(e.agg(F.min(F.to_date("ts")).alias("t0")))  # one row
    return e.crossJoin(F.broadcast(one)).select("event_id", (1 + F.col("user_id") % F.col("m")).alias("instrument_id"), "event_type", F.date_add("d0", 80 * F.datediff(F.to_date("ts"), F.col("t0"))).alias("at"))


@query(f"""WITH {SQL_BARS}, {_EV} SELECT event_id, ev.instrument_id, ev.at, CASE WHEN ev.at - b.trade_date <= 5 THEN {r('close')} END AS close
FROM ev ASOF LEFT JOIN bars b ON ev.instrument_id = b.instrument_id AND ev.at >= b.trade_date""")
def last_close_at_event(spark, sf) -> DataFrame:
    """Latest close at or before each event, none if it is older than five days."""
    b = bars_daily(spark, sf).select("instrument_id", "trade_date", half_up(F.col("close")).alias("close"))
    return A.last_before(events_on_bars(spark, sf).drop("event_type"), b, "instrument_id", "at", "trade_date", "close", 5)


_OUT = f"""{SQL_BARS}, {SQL_BENCH}, {_EV}, o AS (SELECT instrument_id, trade_date, close, {", ".join(f"lead(close, {h}) OVER ({W}) AS c{h}, lead(trade_date, {h}) OVER ({W}) AS d{h}" for h in (1, 5, 10))} FROM bars),
a AS (SELECT event_id, event_type, o.* FROM ev ASOF JOIN o ON ev.instrument_id = o.instrument_id AND ev.at < o.trade_date),
x AS ({" UNION ALL ".join(f"SELECT event_type, {h} AS h, (c{h} - close) / close * 100 - (q.bench - p.bench) / p.bench * 100 AS excess FROM a JOIN benchmark_days p ON p.trade_date = a.trade_date JOIN benchmark_days q ON q.trade_date = d{h} WHERE close > 0 AND p.bench > 0 AND c{h} IS NOT NULL" for h in (1, 5, 10))})"""


@query(f"""WITH {_OUT} SELECT event_type, h, count(*) AS n, {r('avg(excess)', 3)} AS mean, {r('stddev_samp(excess) / sqrt(count(*))', 3)} AS se, {r('avg((excess > 0)::INT) * 100', 2)} AS hit_rate, {r('quantile_cont(excess, 0.9)', 3)} AS p90, {r('quantile_cont(excess, 0.1)', 3)} AS p10 FROM x GROUP BY ALL""")
def event_study(spark, sf) -> DataFrame:
    """Excess return after events, from the first close after each, by kind of event and horizon."""
    b = written(bars_daily(spark, sf), "bars")
    o = b.select(*KEYS, "close", *(F.lead(c, h).over(S.by()).alias(f"{c[0]}{h}") for h in (1, 5, 10) for c in ("close", "trade_date")))
    cols = ["close", *(f"{c}{h}" for h in (1, 5, 10) for c in "ct")]
    a = A.first_after(events_on_bars(spark, sf), o, "instrument_id", "at", "trade_date", cols)
    x = a.select("event_type", "anchor_date", "close", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"c{h}").alias("c"), F.col(f"t{h}").alias("d")) for h in (1, 5, 10)])).alias("x")).select("event_type", "anchor_date", "close", "x.*")
    m = benchmark(b)
    x = x.join(m.select(F.col("trade_date").alias("anchor_date"), F.col("bench").alias("p")), "anchor_date").join(m.select(F.col("trade_date").alias("d"), F.col("bench").alias("q")), "d").where("close > 0 AND p > 0 AND c IS NOT NULL")
    x = x.withColumn("excess", (F.col("c") - F.col("close")) / F.col("close") * 100 - (F.col("q") - F.col("p")) / F.col("p") * 100)
    x = written(x.select("event_type", "h", "excess"), "event-returns")
    n = F.count(F.lit(1))
    g = x.groupBy("event_type", "h").agg(n.alias("n"), half_up(F.avg("excess"), 3).alias("mean"), half_up(F.stddev_samp("excess") / F.sqrt(n), 3).alias("se"), half_up(F.avg((F.col("excess") > 0).cast("int")) * 100, 2).alias("hit_rate"))
    q = X.quantiles(x, "excess", ["event_type", "h"], {"p90": 0.9, "p10": 0.1})
    return g.join(q, ["event_type", "h"]).select(*g.columns, half_up(F.col("p90"), 3).alias("p90"), half_up(F.col("p10"), 3).alias("p10"))


_NEWS = """news AS (SELECT doc_id, source, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS seen, CASE quality WHEN 1 THEN 0.5::DOUBLE ELSE -0.75::DOUBLE END AS score, (doc_id % 10) / 10.0::DOUBLE AS neutral FROM documents JOIN labels USING (doc_id))"""


def scored_news(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("seen"), F.when(F.col("quality") == 1, 0.5).otherwise(-0.75).alias("score"), ((F.col("doc_id") % 10) / 10).alias("neutral"))


@query(f"""WITH {_NEWS}, d AS (SELECT source, CAST(unnest(range(DATE '2024-01-31', DATE '2025-02-01', INTERVAL 30 DAY)) AS DATE) AS as_of FROM (SELECT DISTINCT source FROM documents)),
j AS (SELECT d.source, as_of, as_of - seen AS age, score, pow(0.5::DOUBLE, (as_of - seen) / 7.0::DOUBLE) * (1 - neutral) AS w FROM d JOIN news ON news.source = d.source AND seen <= as_of AND seen > as_of - 30)
SELECT source, as_of, count(*) AS articles, {r('CASE WHEN count(*) >= 3 AND sum(w) > 0 THEN sum(w * score) / sum(w) END')} AS mean, {r('coalesce(CASE WHEN count(*) >= 3 AND sum(w) > 0 THEN 50 + 50 * sum(w * score) / sum(w) END, 50)')} AS score, min(age) AS newest FROM j GROUP BY ALL""")
def weighted_sentiment(spark, sf) -> DataFrame:
    """Sentiment of each source on dates 30 days apart, of articles seen in the 30 days up to each."""
    n = scored_news(spark, sf)
    d = table(spark, sf, "documents").select("source").distinct().select("source", F.explode(F.sequence(F.lit("2024-01-31").cast("date"), F.lit("2025-01-31").cast("date"), F.expr("interval 30 days"))).alias("as_of"))
    p = A.within_days(d, n, "source", "as_of", "seen", 30)
    s = A.sentiment(p, ["source", "as_of"], F.datediff("as_of", "seen"), F.col("score"), F.col("neutral"))
    return s.select("source", "as_of", "articles", half_up(F.col("mean")).alias("mean"), half_up(F.col("score")).alias("score"), "newest")


@query(f"""WITH q AS (SELECT l_suppkey AS instrument_id, CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end, floor(sum(l_quantity) * 100 + 0.5) / 100 AS eps FROM lineitem GROUP BY ALL),
a AS (SELECT *, CAST(period_end + CAST(CASE WHEN month(period_end) = 3 THEN 60 ELSE 45 END AS INTEGER) AS DATE) AS available_at FROM q),
d AS (SELECT instrument_id, CAST(unnest(range(DATE '1994-01-01', DATE '1998-01-02', INTERVAL 1 YEAR)) AS DATE) AS as_of FROM (SELECT DISTINCT instrument_id FROM a)),
k AS (SELECT d.instrument_id, as_of, eps, available_at, row_number() OVER (PARTITION BY d.instrument_id, as_of ORDER BY period_end DESC) AS k FROM d JOIN a ON a.instrument_id = d.instrument_id AND available_at < as_of)
SELECT instrument_id, as_of, count(*) AS known, CASE WHEN count(*) FILTER (WHERE k <= 4) = 4 THEN sum(eps) FILTER (WHERE k <= 4) END AS eps4, CASE WHEN count(*) FILTER (WHERE k > 4) = 4 THEN sum(eps) FILTER (WHERE k > 4) END AS eps4_before, min(as_of - available_at) AS days_since
FROM k WHERE k <= 8 GROUP BY ALL""")
def trailing_results(spark, sf) -> DataFrame:
    """Sums of the last four known quarters and the four before, on the first day of each year."""
    li = table(spark, sf, "lineitem")
    q = li.groupBy(F.col("l_suppkey").alias("instrument_id"), F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("period_end")).agg((F.floor(F.sum("l_quantity") * 100 + 0.5) / 100).alias("eps")).withColumn("available_at", fallback_available(F.col("period_end")))
    d = q.select("instrument_id").distinct().select("instrument_id", F.explode(F.sequence(F.lit("1994-01-01").cast("date"), F.lit("1998-01-01").cast("date"), F.expr("interval 1 year"))).alias("as_of"))
    return A.trailing_quarters(q, d, "instrument_id")


@query(f"""WITH {SQL_BARS}, m AS (SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1994-06-01' END AS start, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1997-06-01' END AS stop FROM supplier WHERE s_suppkey % 7 > 0)
SELECT bars.instrument_id, count(*) AS days, min(trade_date) AS first, max(trade_date) AS last FROM bars LEFT JOIN m USING (instrument_id) WHERE coalesce(trade_date >= start, true) AND coalesce(trade_date < stop, true) GROUP BY ALL""")
def member_days(spark, sf) -> DataFrame:
    """Bars of the days on which an instrument is a member; without a window it always is."""
    m = table(spark, sf, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("instrument_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("1994-06-01").cast("date")).alias("start"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("1997-06-01").cast("date")).alias("stop"))
    b = bars_daily(spark, sf).join(m, "instrument_id", "left").where(A.member(F.col("trade_date"), F.col("start"), F.col("stop")))
    return b.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("days"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
