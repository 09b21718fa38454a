"""Alerts that are sent as they come, tried again, and sent anew later where that did not help."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "id string, created_at timestamp, text string, ok boolean, attempts int, error string"
#: Seconds before the second and the third try; how many are sent anew at a time.
WAITS, RESENT = (1.0, 2.0), 20


def sent(alerts: DataFrame, send: Callable[[str], None], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """OUTCOME of each alert (id, created_at, text): ``send`` raises what went wrong, and is called again after each of ``waits``. Partitions send beside each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                error, attempts = None, 0
                for wait in (None, *waits):
                    if wait is not None:
                        sleep(wait)
                    attempts += 1
                    try:
                        send(text)
                        error = None
                        break
                    except Exception as e:
                        error = str(e) or type(e).__name__
                rows.append((error is None, attempts, error))
            yield b.assign(**dict(zip(("ok", "attempts", "error"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True)))

    return alerts.select(F.col("id").cast("string").alias("id"), "created_at", "text").mapInPandas(run, OUTCOME)


def sink(send: Callable[[str], None], store: str, **how) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: sends a micro-batch and keeps its outcomes under ``store``; a batch that is run again takes the place of its outcomes, so alerts may be sent twice but are not lost."""
    def write(batch: DataFrame, number: int) -> None:
        sent(batch, send, **how).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return write


def undelivered(spark: SparkSession, store: str) -> DataFrame:
    """id, created_at, text of alerts that no outcome under ``store`` has as delivered."""
    x = spark.read.schema(OUTCOME).parquet(store)
    return x.groupBy("id").agg(F.min("created_at").alias("created_at"), F.min_by("text", "created_at").alias("text"), F.bool_or("ok").alias("ok")).where("NOT ok").drop("ok")


def resend(spark: SparkSession, store: str, send: Callable[[str], None], limit: int = RESENT, **how) -> int:
    """Send the oldest undelivered alerts anew, ``limit`` at most; how many got through. Their outcomes go under ``store`` as well."""
    path = f"{store}/batch=resent-{uuid.uuid4().hex}"
    sent(undelivered(spark, store).orderBy("created_at", "id").limit(limit), send, **how).write.parquet(path)
    return spark.read.schema(OUTCOME).parquet(path).where("ok").count()
