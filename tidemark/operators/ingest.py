"""What a run of the news ingest reports of its sources: conditions, which of them are new, and the run's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FROZEN_DAYS = 3


def source_alerts(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """run, status, alerts, new_alerts (sorted arrays) of each run.

    sources: run, source, error (null: none), parsed, newest (time of the newest item, null: none). runs: run (numbered without gaps),
    fetched_at, degraded (scoring was down). A source alerts when it fails, or brings nothing, in two runs on end, and when its newest
    item is over FROZEN_DAYS old; scoring, when it was down in two. An alert is new if the run before did not have it. A run failed if
    all its sources did, and is degraded with any failure, alert or without scoring.
    """
    of_source = Window.partitionBy("source").orderBy("run")
    before = F.lag("run").over(of_source) == F.col("run") - 1
    was_failed, was_empty = before & F.lag(F.col("error").isNotNull()).over(of_source), before & F.lag(F.col("error").isNull() & (F.col("parsed") == 0)).over(of_source)
    x = sources.join(runs.select("run", "fetched_at"), "run").withColumn("f", was_failed).withColumn("e", was_empty)
    failed = F.col("error").isNotNull()
    alert = F.array_compact(F.array(
        F.when(failed & F.coalesce("f", F.lit(False)), F.concat(F.lit("failed:"), "source", F.lit(":"), "error")),
        F.when(~failed & (F.col("newest") < F.timestamp_add("DAY", F.lit(-FROZEN_DAYS), F.col("fetched_at"))), F.concat(F.lit("frozen:"), "source", F.lit(":"), F.date_format("newest", "yyyy-MM-dd"))),
        F.when(~failed & (F.col("parsed") == 0) & F.coalesce("e", F.lit(False)), F.concat(F.lit("empty:"), F.col("source"))),
    ))
    own = x.groupBy("run").agg(F.flatten(F.collect_list(alert)).alias("own"), F.count(F.when(failed, 1)).alias("failures"), F.count(F.lit(1)).alias("n"))
    # Runs are few beside what they bring in: a window over all of them, a row a run.
    in_order = Window.partitionBy(F.lit(0)).orderBy("run")
    y = runs.join(own, "run", "left").withColumn("down", F.col("degraded") & F.coalesce(F.lag("degraded").over(in_order), F.lit(False)))
    y = y.withColumn("alerts", F.array_sort(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.when(F.col("down"), F.array(F.lit("scoring"))).otherwise(F.array().cast("array<string>")))))
    y = y.withColumn("new_alerts", F.array_except("alerts", F.coalesce(F.lag("alerts").over(in_order), F.array().cast("array<string>"))))
    n, failures = F.coalesce("n", F.lit(0)), F.coalesce("failures", F.lit(0))
    status = F.when((n > 0) & (failures == n), "failed").when((failures > 0) | (F.size("alerts") > 0) | F.col("degraded"), "degraded").otherwise("ok")
    return y.select("run", status.alias("status"), "alerts", "new_alerts")
