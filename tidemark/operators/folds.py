"""Windows of training and test over a calendar: training always from the warm-up on, and ended an embargo before its test, whose trades it must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dated(calendar: DataFrame, n: int, warmup: int, embargo: int, first: Column, size: Column, ok: Column) -> DataFrame:
    """fold, the first and last dates of both windows and their lengths, from the place of the first test day and a test's length; none unless ``ok``."""
    every = Window.partitionBy(F.lit(0))  # the calendar: a row a date
    c = calendar.select("trade_date").distinct().withColumn("i", F.row_number().over(every.orderBy("trade_date")) - 1).withColumn("total", F.count(F.lit(1)).over(every))
    c = c.withColumn("first", first).withColumn("size", size).where(ok & (F.col("size") > 0))
    k = c.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else c.withColumn("fold", F.lit(0)).limit(0)
    begin = F.col("first") + F.col("size") * (F.col("fold") - 1)
    end = F.when(F.col("fold") == n, F.col("total")).otherwise(begin + F.col("size"))
    train = (F.col("i") >= warmup) & (F.col("i") < F.greatest(F.lit(warmup), begin - embargo))
    test = (F.col("i") >= begin) & (F.col("i") < end)
    of = lambda f, c: f(F.when(c, F.col("trade_date")))
    days = lambda c: F.count(F.when(c, 1))
    return k.groupBy("fold").agg(of(F.min, train).alias("train_from"), of(F.max, train).alias("train_to"), days(train).alias("train_days"), of(F.min, test).alias("test_from"), of(F.max, test).alias("test_to"), days(test).alias("test_days"))


def expanding(calendar: DataFrame, n: int, warmup: int = 0, embargo: int = 0) -> DataFrame:
    """``n`` tests one after the other, of a length of the days after the warm-up over n + 1; the last one to the end. A calendar too short gives none."""
    size = F.floor((F.col("total") - warmup) / (n + 1))
    return _dated(calendar, n, warmup, embargo, warmup + size, size, F.lit(True))


def anchored(calendar: DataFrame, n: int, first_test: int, warmup: int = 0, embargo: int = 0) -> DataFrame:
    """``n`` tests that share the days from ``first_test`` on. None if the calendar is too short or the first test begins within the warm-up and the embargo."""
    return _dated(calendar, n, warmup, embargo, F.lit(first_test), F.floor((F.col("total") - first_test) / max(n, 1)), F.lit(first_test > warmup + embargo))
