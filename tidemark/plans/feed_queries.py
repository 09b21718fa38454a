"""Company pages and the ingest's reports, on pages and runs that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.strings import by_canonical_symbol
from ..operators import folds, ingest
from ..sources import company_pages as C
from ..sources.market import SQL_BARS, SQL_MONTHS, bars_daily, bars_monthly, table
from .registry import query, r

_QUARTERS = """SELECT l_suppkey AS instrument_id, CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end, floor(sum(l_extendedprice)) AS sales, sum(l_quantity) AS eps,
  sum(CASE WHEN l_returnflag = 'R' THEN -3 ELSE 1 END * l_quantity) AS net_profit FROM lineitem GROUP BY ALL"""


def rendered(spark, sf) -> DataFrame:
    """instrument_id, html: each supplier's quarters as a company page would show them, newest last; a quarter that lost money shows no EPS."""
    li = table(spark, sf, "lineitem")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    q = li.groupBy(F.col("l_suppkey").alias("instrument_id"), end.alias("end")).agg(F.floor(F.sum("l_extendedprice")).alias("sales"), F.sum("l_quantity").alias("eps"), F.sum(F.when(F.col("l_returnflag") == "R", -3).otherwise(1) * F.col("l_quantity")).alias("profit"))
    x = q.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("end", "sales", "eps", "profit"))).alias("q"))
    cells = lambda f: F.array_join(F.transform("q", f), "")
    cell = lambda v: F.concat(F.lit('<td class="">\n '), v, F.lit("\n</td>"))
    row = lambda name, f: F.concat(F.lit(f'<tr class="stripe">\n <td class="text"> <button>{name}&nbsp;<span>+</span></button>\n</td>'), cells(f), F.lit("\n</tr>\n"))
    head = cells(lambda r: F.concat(F.lit('<th class=""> '), F.date_format(r["end"], "MMM yyyy"), F.lit(" </th>")))
    html = F.concat(
        F.lit('<html><ul><li class="flex"><span class="name">\n Market Cap </span> <span class="number">'), F.format_number(F.aggregate("q", F.lit(0).cast("bigint"), lambda s, r: s + r["sales"]), 0), F.lit('</span> Cr.</li></ul><section id="quarters"><table><thead><tr><th class="text"></th>'), head, F.lit("</tr></thead><tbody>\n"),
        row("Sales", lambda r: cell(F.format_number(r["sales"], 0))), row("Net Profit", lambda r: cell(F.format_number(r["profit"], 1))), row("EPS in Rs", lambda r: cell(F.when(r["profit"] < 0, F.lit("")).otherwise(F.format_number(r["eps"], 2)))),
        F.lit("</tbody></table></section></html>"),
    )
    return x.select("instrument_id", html.alias("html"))


@query(f"""WITH q AS ({_QUARTERS}), l AS (SELECT instrument_id, period_end, lead(sales) OVER w AS sales, CASE WHEN lead(net_profit) OVER w >= 0 THEN lead(eps) OVER w END AS eps, lead(net_profit) OVER w AS net_profit FROM q WINDOW w AS (PARTITION BY instrument_id ORDER BY period_end))
SELECT instrument_id, period_end, CAST(eps AS DOUBLE) AS eps, CAST(net_profit AS DOUBLE) AS net_profit, CAST(sales AS DOUBLE) AS sales FROM l WHERE eps IS NOT NULL""")
def company_quarters(spark, sf) -> DataFrame:
    """Quarters read back from the pages. These end each row with white space after the last cell, which counts as a cell, as on the pages that the rule was made for: so a column holds what the next one's header names."""
    return C.quarters(rendered(spark, sf), "instrument_id")


@query(f"WITH q AS ({_QUARTERS}) SELECT instrument_id, 0 AS place, 'Market Cap' AS name, CAST(sum(sales) AS DOUBLE) AS value FROM q GROUP BY instrument_id")
def company_ratios(spark, sf) -> DataFrame:
    return C.ratios(rendered(spark, sf), "instrument_id")


_RUNS = """g AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT day, row_number() OVER (ORDER BY day) AS run, sum(n) % 3 = 0 AS degraded FROM g GROUP BY day),
s AS (SELECT run, source, CASE WHEN n % 3 = 0 THEN 'HTTP 503' END AS error, n % 4 // 2 AS parsed, day + INTERVAL 8 HOUR - to_days(CAST(n % 5 AS INTEGER)) AS newest FROM g JOIN d USING (day))"""


@query(f"""WITH {_RUNS}, p AS (SELECT s.*, (day + INTERVAL 20 HOUR) AS fetched, b.error AS b_error, b.parsed AS b_parsed, b.run AS b_run FROM s JOIN d USING (run) LEFT JOIN s b ON b.source = s.source AND b.run = s.run - 1),
a AS (SELECT run, 'failed:' || source || ':' || error AS alert FROM p WHERE error IS NOT NULL AND b_error IS NOT NULL UNION ALL SELECT run, 'frozen:' || source || ':' || strftime(newest, '%Y-%m-%d') FROM p WHERE error IS NULL AND newest < fetched - INTERVAL 3 DAY
  UNION ALL SELECT run, 'empty:' || source FROM p WHERE error IS NULL AND parsed = 0 AND b_run IS NOT NULL AND b_error IS NULL AND b_parsed = 0 UNION ALL SELECT x.run, 'scoring' FROM d x JOIN d y ON y.run = x.run - 1 WHERE x.degraded AND y.degraded),
l AS (SELECT run, list_sort(list(alert)) AS alerts FROM a GROUP BY run), f AS (SELECT run, count(error) AS failures, count(*) AS n FROM s GROUP BY run)
SELECT d.run, CASE WHEN failures = n THEN 'failed' WHEN failures > 0 OR l.alerts IS NOT NULL OR degraded THEN 'degraded' ELSE 'ok' END AS status, coalesce(array_to_string(l.alerts, '|'), '') AS alerts,
  coalesce(array_to_string(list_filter(l.alerts, lambda x: NOT list_contains(coalesce(m.alerts, []), x)), '|'), '') AS new_alerts FROM d JOIN f USING (run) LEFT JOIN l USING (run) LEFT JOIN l m ON m.run = d.run - 1""")
def ingest_reports(spark, sf) -> DataFrame:
    """Every day's run: failing, frozen and empty sources, scoring that is down, and what of it is to be paged. A kind of event stands for a source, its number for what went wrong."""
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    d = g.groupBy("day").agg((F.sum("n") % 3 == 0).alias("degraded")).withColumn("run", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))  # a row a run
    d = d.withColumn("fetched_at", F.timestamp_add("HOUR", F.lit(20), F.col("day").cast("timestamp")))
    n = F.col("n")
    s = g.join(d, "day").select("run", "source", F.when(n % 3 == 0, "HTTP 503").alias("error"), F.floor(n % 4 / 2).alias("parsed"), F.timestamp_add("HOUR", F.lit(8), F.date_sub("day", (n % 5).cast("int")).cast("timestamp")).alias("newest"))
    x = ingest.source_alerts(s, d.select("run", "fetched_at", "degraded"))
    return x.select(F.col("run").cast("long").alias("run"), "status", F.array_join("alerts", "|").alias("alerts"), F.array_join("new_alerts", "|").alias("new_alerts"))


@query(f"WITH {SQL_BARS} SELECT instrument_id, trade_date, {r('open')} AS open, {r('close')} AS close, volume FROM bars WHERE trade_date <= DATE '1995-06-30'")
def bars_as_of(spark, sf) -> DataFrame:
    """Bars up to a day; what was traded later is not read from row groups that hold nothing else."""
    b = bars_daily(spark, sf, "1995-06-30")
    return b.select("instrument_id", "trade_date", half_up(F.col("open")).alias("open"), half_up(F.col("close")).alias("close"), "volume")


@query("""WITH x AS (SELECT p_partkey, p_brand || CASE p_partkey % 4 WHEN 0 THEN '-EQ' WHEN 1 THEN '-BE' WHEN 2 THEN '-XX' ELSE '' END AS symbol FROM part), y AS (SELECT *, regexp_replace(upper(trim(symbol)), '-(EQ|BE|BZ|SM|ST)$', '') AS canonical FROM x)
SELECT canonical, min(p_partkey) AS first, count(*) - 1 AS collisions FROM y GROUP BY canonical""")
def symbol_collisions(spark, sf) -> DataFrame:
    """Listings that are one name without their series: the first one stands, the others are reported."""
    key = F.col("p_partkey") % 4
    x = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.when(key == 0, "-EQ").when(key == 1, "-BE").when(key == 2, "-XX").otherwise("")).alias("symbol"))
    return by_canonical_symbol(x, "symbol", ["p_partkey"]).select("canonical", F.col("p_partkey").alias("first"), "collisions")


_FOLD = "min(trade_date) FILTER (WHERE {t}) AS train_from, max(trade_date) FILTER (WHERE {t}) AS train_to, count(*) FILTER (WHERE {t}) AS train_days, min(trade_date) FILTER (WHERE {e}) AS test_from, max(trade_date) FILTER (WHERE {e}) AS test_to, count(*) FILTER (WHERE {e}) AS test_days".format(
    t="i >= 12 AND i < greatest(12, b - 2)", e="i >= b AND (i < b + size OR fold = 4)"
)


@query(f"""WITH {SQL_BARS}, {SQL_MONTHS}, c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT trade_date FROM months)),
k AS (SELECT 'expanding' AS kind, c.*, CAST(floor((total - 12) / 5) AS BIGINT) AS size, 12 + CAST(floor((total - 12) / 5) AS BIGINT) * f.range AS b, f.range AS fold FROM c, range(1, 5) f
  UNION ALL SELECT 'anchored', c.*, CAST(floor((total - 40) / 4) AS BIGINT), 40 + CAST(floor((total - 40) / 4) AS BIGINT) * (f.range - 1), f.range FROM c, range(1, 5) f)
SELECT kind, CAST(fold AS INTEGER) AS fold, {_FOLD} FROM k GROUP BY kind, fold""")
def fold_windows(spark, sf) -> DataFrame:
    """Four folds of months of each kind, after a year of warm-up and with two months of embargo; the anchored ones test from the 41st month on."""
    c = bars_monthly(bars_daily(spark, sf)).select("trade_date").distinct()
    return folds.expanding(c, 4, 12, 2).withColumn("kind", F.lit("expanding")).unionByName(folds.anchored(c, 4, 40, 12, 2).withColumn("kind", F.lit("anchored")))
