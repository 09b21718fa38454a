"""Tables of reference: options near the money, unions in which the first table wins, stamps of dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def option_band(contracts: DataFrame, spots: DataFrame, today: Column, band: int) -> DataFrame:
    """contracts (name, expiry, strike, any other columns) of each name's nearest expiry from ``today`` on, at most ``band`` steps from the strike at the money; with step and atm.

    spots: name, ltp. A step is the smallest gap between different strikes of that expiry; the strike at the money is the multiple of the step
    that is nearest to the price, upwards from the middle. A name without price, with no expiry to come, or with one strike only has no band.
    """
    nearest = contracts.where(F.col("expiry") >= today).groupBy("name").agg(F.min("expiry").alias("expiry"))
    x = contracts.join(nearest, ["name", "expiry"])
    gap = F.col("strike") - F.lag("strike").over(Window.partitionBy("name").orderBy("strike"))
    steps = x.select("name", "strike").distinct().withColumn("gap", gap).groupBy("name").agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("step"))
    at = steps.join(spots.select("name", "ltp"), "name").where("step > 0 AND ltp IS NOT NULL").select("name", "step", (F.floor(F.col("ltp") / F.col("step") + 0.5) * F.col("step")).alias("atm"))
    return x.join(at, "name").where(F.abs(F.col("strike") - F.col("atm")) <= band * F.col("step"))


def first_wins(parts: Sequence[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The union of ``parts`` by name, of each key one row: the one of the first part that has it, there the first by ``order``, then by all columns. Aggregated before the shuffle."""
    whole = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        whole = p if whole is None else whole.unionByName(p)
    rest = [c for c in parts[0].columns if c not in keys]
    rank = F.struct("_part", *order, *(c for c in rest if c not in order))
    return whole.groupBy(*keys).agg(F.min(rank).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def dictionary_stamp(entries: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """One row, ``stamp``: prefix-, and 12 hex digits of the SHA-256 of the dictionary's compact JSON, [[key,[values]],...] with both sorted by code point.

    For dictionaries (aliases, exclusions), whose JSON is one string; order and repeats of rows do not change it, contents do. Rows without key or value are no entries.
    """
    own = entries.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("v"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    entry = F.concat(F.lit("["), quoted(f"`{key}`"), F.lit(","), F.to_json("v"), F.lit("]"))
    all_ = own.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["e"]), ","), F.lit("]"))
    return all_.select(F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 12)).alias("stamp"))
