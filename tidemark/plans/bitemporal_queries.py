"""Corrections: a line is reported some days after it was shipped, and every report restates the quarter of the shipment.

The tables have no day of receipt; (7 * order + line) % 75 days stand in for the delay, so reports come out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bitemporal as B
from ..sources.market import table
from .registry import query

_LINES = "lines AS (SELECT l_suppkey AS instrument_id, l_quantity AS q, CAST(l_shipdate AS DATE) AS shipped, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, CAST(l_shipdate AS DATE) + CAST((7 * l_orderkey + l_linenumber) % 75 AS INTEGER) AS known FROM lineitem)"
_LOG = f"{_LINES}, log AS (SELECT instrument_id, quarter, known, sum(q) AS q, count(*) AS n FROM lines GROUP BY ALL)"


def restatements(spark, sf) -> DataFrame:
    """instrument_id, quarter, known, total, lines: what a quarter came to with all reports up to ``known``."""
    li = table(spark, sf, "lineitem")
    x = li.groupBy(F.col("l_suppkey").alias("instrument_id"), F.to_date(F.trunc("l_shipdate", "quarter")).alias("quarter"), F.date_add(F.to_date("l_shipdate"), ((7 * F.col("l_orderkey") + F.col("l_linenumber")) % 75).cast("int")).alias("known")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("instrument_id", "quarter").orderBy("known").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("instrument_id", "quarter", "known", F.sum("q").over(w).cast("double").alias("total"), F.sum("n").over(w).alias("lines"))


@query(f"""WITH {_LOG} SELECT instrument_id, quarter, known AS known_from, lead(known) OVER w AS known_to, CAST(sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lines
FROM log WINDOW w AS (PARTITION BY instrument_id, quarter ORDER BY known)""")
def restated_quarters(spark, sf) -> DataFrame:
    """Every version of every quarter and from when to when it held."""
    return B.versions(restatements(spark, sf), ["instrument_id", "quarter"], "known", "lines")


@query(f"WITH {_LINES} SELECT instrument_id, quarter, CAST(sum(q) AS DOUBLE) AS total, count(*) AS lines FROM lines WHERE known <= DATE '1996-02-10' AND quarter <= DATE '1995-12-31' GROUP BY ALL")
def quarters_as_known(spark, sf) -> DataFrame:
    """One run's view: the quarters up to the end of 1995 as they stood on 10 February 1996."""
    log = restatements(spark, sf)
    return B.view(log.select("instrument_id", "quarter", "known", "lines", "total"), ["instrument_id", "quarter"], "known", F.lit("1996-02-10").cast("date"), "quarter", F.lit("1995-12-31").cast("date")).select("instrument_id", "quarter", "total", "lines")


@query(f"""WITH {_LINES}, m AS (SELECT DISTINCT instrument_id, CAST(last_day(shipped) AS DATE) AS run FROM lines),
x AS (SELECT m.instrument_id, run, quarter, sum(q) AS final, sum(q) FILTER (WHERE known <= run) AS seen FROM m JOIN lines ON lines.instrument_id = m.instrument_id AND quarter <= run AND quarter > run - 365 GROUP BY ALL)
SELECT instrument_id, run, count(seen) AS quarters, CAST(sum(seen) AS DOUBLE) AS seen, CAST(sum(final) FILTER (WHERE seen IS NOT NULL) AS DOUBLE) AS final FROM x GROUP BY ALL HAVING count(seen) > 0""")
def run_views(spark, sf) -> DataFrame:
    """For a run at the end of each month in which an instrument shipped: the year's quarters as they were known then, and what the same quarters came to in the end."""
    facts = B.versions(restatements(spark, sf), ["instrument_id", "quarter"], "known", "lines")
    last = Window.partitionBy("instrument_id", "quarter")
    facts = facts.withColumn("final", F.max("total").over(last))
    runs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("instrument_id"), F.last_day("l_shipdate").alias("run")).distinct()
    x = B.views(runs, facts, "instrument_id", "run", "quarter", 365)
    return x.groupBy("instrument_id", "run").agg(F.count(F.lit(1)).alias("quarters"), F.sum("total").alias("seen"), F.sum("final").alias("final"))
