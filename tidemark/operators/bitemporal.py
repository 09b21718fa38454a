"""Facts with two times: the day that they are about (valid) and the moment from which they are known. Corrections are added, never written over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame, keys: list[str], known: str, rank: str | None = None) -> DataFrame:
    """``log`` with known_from (included) and known_to (excluded, null: still so) of each row, which is a version of the fact that ``keys`` (valid time among them) names.

    Of rows that come at the same moment the greatest by ``rank``, then by all columns, counts. One window a fact: no task holds more than its versions.
    """
    rest = [c for c in log.columns if c not in (*keys, known)]
    first = [c for c in (rank,) if c]
    one = log.where(F.col(known).isNotNull()).groupBy(*keys, known).agg(F.max(F.struct(*first, *(c for c in rest if c not in first))).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(known)
    return one.withColumn("known_to", F.lead(known).over(w)).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), F.col(known).alias("known_from"), "known_to")


def known_at(at: Column) -> Column:
    """For versions: the one that held at ``at``."""
    return (F.col("known_from") <= at) & F.coalesce(F.col("known_to") > at, F.lit(True))


def view(log: DataFrame, keys: list[str], known: str, at: Column, valid: str | None = None, upto: Column | None = None, retracted: str | None = None) -> DataFrame:
    """The facts as one run saw them at ``at``: what came later is not asked of the scan, of a fact the newest row counts, retracted facts are out.

    Aggregated before the shuffle, so facts that were corrected often cost no more than others. ``upto``: only facts about this day or earlier.
    """
    x = log.where(F.col(known) <= at)
    if valid is not None and upto is not None:
        x = x.where(F.col(valid) <= upto)
    rest = [c for c in log.columns if c not in (*keys, known)]
    x = x.groupBy(*keys).agg(F.max(F.struct(known, *rest)).alias("_r")).select(*keys, "_r.*")
    return x.where(~F.coalesce(F.col(retracted), F.lit(False))) if retracted else x


def views(runs: DataFrame, facts: DataFrame, key: str, at: str, valid: str, days: int, retracted: str | None = None) -> DataFrame:
    """runs (key, ``at``, any other columns) with the facts about the ``days`` days up to ``at``'s, in the version that held at ``at``.

    facts: what ``versions`` returns. Facts and runs meet under equal keys and windows of ``days`` days, so a run meets twice its own window's
    facts and not its key's history; of a fact one version holds at any moment, so none comes twice. Runs without facts have no row.
    """
    window = F.floor(F.unix_date(F.to_date(valid)) / days)
    f = facts if retracted is None else facts.where(~F.coalesce(F.col(retracted), F.lit(False)))
    f = f.withColumn("_w", F.explode(F.array(window, window + 1)))
    day = F.to_date(at)
    both = runs.withColumn("_w", F.floor(F.unix_date(day) / days)).join(f, [key, "_w"])
    return both.where((F.to_date(valid) <= day) & (F.to_date(valid) > F.date_sub(day, days)) & known_at(F.col(at))).drop("_w")
