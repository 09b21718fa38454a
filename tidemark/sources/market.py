"""Bars, sectors, benchmark and calendar from the star-schema tables.

A supplier stands for an instrument; its day's line items are the trades: price = extended price / quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str, as_of: str | None = None, dealt: int = 0, block: int = 0) -> DataFrame:
    """instrument_id, trade_date, open, high, low, close, volume. One shuffle, summed before it. ``as_of``: up to this day, which is asked of the scan.

    ``dealt``: line items are dealt by instrument into so many parts first, and bars are made where they lie: what goes along
    an instrument's bars then needs no shuffle of its own, and a line item is half as wide as the sums of one. ``block``: they
    are dealt by instrument and _block, so many days each, which comes with the bars.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    raw = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    if as_of is not None:
        raw = raw.where(F.col("l_shipdate") < F.lit(as_of).cast("date") + F.expr("interval 1 day"))
    raw = raw.select(F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("trade_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    keys = ["instrument_id"]
    if block:
        raw, keys = raw.withColumn("_block", F.floor(F.unix_date("trade_date") / block)), ["instrument_id", "_block"]
    if dealt:
        raw = raw.repartition(dealt, *keys)
    rows = raw.select(*keys, "trade_date", price.alias("p"), order.alias("o"), "l_quantity")
    return rows.groupBy(*keys, "trade_date").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume")
    )


def bars_monthly(bars: DataFrame) -> DataFrame:
    """The same columns by month; trade_date is the month's first day."""
    return bars.groupBy("instrument_id", F.trunc("trade_date", "month").alias("m")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("m", "trade_date")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, sector: the region of the supplier's nation."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("instrument_id"), F.col("r_name").alias("sector"))


def benchmark(bars: DataFrame) -> DataFrame:
    """trade_date, bench: the equal-weight mean of closes, to 4 places so that it doesn't hang on the order of a sum."""
    from ..functions.numbers import half_up

    return bars.groupBy("trade_date").agg(half_up(F.avg("close")).alias("bench"))


# ---------------------------------------------------------------- the same in DuckDB

SQL_BARS = """bars AS (
  SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""
SQL_MONTHS = """months AS (
  SELECT instrument_id, CAST(date_trunc('month', trade_date) AS DATE) AS trade_date, arg_min(open, bars.trade_date) AS open,
         max(high) AS high, min(low) AS low, arg_max(close, bars.trade_date) AS close, sum(volume) AS volume
  FROM bars GROUP BY instrument_id, date_trunc('month', bars.trade_date))"""
SQL_SECTORS = """sectors AS (
  SELECT s_suppkey AS instrument_id, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_BENCH = "benchmark_days AS (SELECT trade_date, floor(avg(close) * 1e4 + 0.5) / 1e4 AS bench FROM bars GROUP BY trade_date)"
