"""What each gate is worth: outcomes by pattern of failed gates, from which every configuration is read without going back to the bars.

A bar has a bit for each gate that fails, floors one for each level. Bars are counted once by regime and pattern; that table
has at most 2 ** gates rows a regime, however many bars there are. A configuration is a mask a regime: a bar passes if
none of the gates in the mask fails.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio


def outcome_cube(rows: DataFrame, regime: str, gates: Mapping[str, Column], net: str) -> DataFrame:
    """regime, failed (bits, in the order of ``gates``; null counts as failed), n, wins, gain and loss: rows with a net, in hundredths of a per cent, so that sums are exact."""
    failed = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, c in enumerate(gates.values())), F.lit(0).cast("long"))
    x = rows.where(F.col(net).isNotNull()).select(regime, failed.alias("failed"), F.floor(F.col(net) * 100 + 0.5).alias("k"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.abs("k"))), F.lit(0))
    return x.groupBy(regime, "failed").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") > 0, 1)).alias("wins"), part(F.col("k") > 0).alias("gain"), part(F.col("k") <= 0).alias("loss"))


def configurations(spark, gates: Sequence[str], masks: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """config, regime, mask: for each configuration the gates that stand in each regime; a regime without gates is not traded."""
    at = {g: 1 << i for i, g in enumerate(gates)}
    return spark.createDataFrame([(c, r, sum(at[g] for g in on)) for c, by in masks.items() for r, on in by.items()], "config string, regime string, mask long")


def outcomes(cube: DataFrame, configs: DataFrame) -> DataFrame:
    """config, n, win_rate, expectancy (per cent), profit_factor (null without losses). Configurations that nothing passes have n 0."""
    c = F.broadcast(configs)  # a row a configuration and regime
    hit = (cube["regime"] == c["regime"]) & (cube["failed"].bitwiseAND(c["mask"]) == 0)
    s = cube.join(c, hit).groupBy("config").agg(*(F.sum(x).alias(x) for x in ("n", "wins", "gain", "loss")))
    every = configs.select("config").distinct().join(s, "config", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("config", n.alias("n"), half_up(ratio(F.col("wins"), F.nullif(n, F.lit(0))) * 100, 2).alias("win_rate"), half_up(ratio(F.col("gain") - F.col("loss"), F.nullif(n, F.lit(0))) / 100, 3).alias("expectancy"), half_up(ratio(F.col("gain"), F.nullif(F.col("loss"), F.lit(0))), 3).alias("profit_factor"))
