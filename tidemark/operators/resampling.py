"""Stationary block bootstrap whose replicates are sums over blocks: no task holds a series or a replicate.

Place t of replicate r begins a block if a hash of both says so (one in ``block``, and the first always); the block goes on
from a place of the series that the hash names, around its end, until the next one begins. A block's sum is the
difference of two running sums, so a replicate of n values costs n / block look-ups, joined by place. Running sums
are made by date: sums of dates, then rows inside each. Values are whole numbers, so nothing hangs on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import deals, written

#: Places that one row deals out.
PIECE = 1 << 12


def _drawn(seed: int, part: int) -> Column:
    """Eight hexadecimal digits of the hash of replicate and place, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate"), F.col("t"))), 1 + 8 * part, 8), 16, 10).cast("long")


def replicates(rows: DataFrame, series: str, date: str, tie: list[str], values: list[str], reps: int, block: int, seed: int) -> DataFrame:
    """series, replicate (0 to reps - 1), size and the sum of each of ``values`` (whole numbers, null: 0) over a resample of the series in order of date and tie."""
    day, whole = Window.partitionBy("_s", "_d"), Window.partitionBy("_s").orderBy("_d")  # whole: a row a date
    x = rows.select(F.col(series).alias("_s"), F.col(date).alias("_d"), *tie, *(F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values))
    x = written(x, "resampled")
    of_day = x.groupBy("_s", "_d").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(v).alias(f"_{v}") for v in values))
    until = lambda c: F.sum(c).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    of_day = of_day.select("_s", "_d", *(until(c).alias(c) for c in ("_n", *(f"_{v}" for v in values))))
    order = day.orderBy(*tie, *values)
    so_far = [(F.col(f"_{v}") + F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)).alias(f"_{v}") for v in values]
    # Hints: written rows and what is exploded from them look smaller to the planner than they are, and what looks small goes through the driver.
    before = x.join(of_day.withColumnsRenamed({"_s": "_ss", "_d": "_dd"}).hint("shuffle_hash"), F.col("_s").eqNullSafe(F.col("_ss")) & F.col("_d").eqNullSafe(F.col("_dd"))).select("_s", (F.col("_n") + F.row_number().over(order) - 1).alias("_i"), *so_far)
    sizes = written(x.groupBy("_s").agg(F.count(F.lit(1)).alias("size"), *(F.sum(v).alias(f"all_{v}") for v in values)), "resampled-sizes")

    pieces = sizes.select("_s", "size", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    # Dealt by number: a piece is a short row that becomes thousands. A replicate's are in one part, where each block finds the next.
    places = pieces.repartition(deals(rows.sparkSession), "_s", "replicate").select("_s", "size", "replicate", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE, F.col("size")) - 1)).alias("t"))
    starts = places.where((F.col("t") == 0) | (_drawn(seed, 0) % block == 0)).withColumn("at", _drawn(seed, 1) % F.col("size"))
    next_ = F.lead("t", 1).over(Window.partitionBy("_s", "replicate").orderBy("t"))
    ends = starts.withColumn("end", F.col("at") + F.coalesce(next_, F.col("size")) - F.col("t"))
    sides = F.explode(F.array(F.struct(F.col("at").alias("i"), F.lit(0).cast("long").alias("around"), F.lit(-1).alias("sign")), F.struct((F.col("end") % F.col("size")).alias("i"), F.floor(F.col("end") / F.col("size")).alias("around"), F.lit(1).alias("sign"))))
    # Looked-up places are 2 * reps / block times the series: they meet it by place, and it is the side that is held.
    looked = ends.select("_s", "replicate", sides.alias("x")).select("_s", "replicate", "x.*").alias("l").join(before.hint("shuffle_hash").alias("b"), (F.col("l.i") == F.col("b._i")) & F.col("l._s").eqNullSafe(F.col("b._s")))
    sums = looked.groupBy("l._s", "replicate").agg(F.sum(F.col("sign") * F.col("around")).alias("_rounds"), *(F.sum(F.col("sign") * F.col(f"_{v}")).alias(v) for v in values))
    z = sizes.withColumnRenamed("_s", "_k")
    done = sums.join(z, F.col("_s").eqNullSafe(F.col("_k")))
    return done.select(F.col("_s").alias(series), "replicate", "size", *((F.col(v) + F.col("_rounds") * F.col(f"all_{v}")).alias(v) for v in values))


def interval(stats: DataFrame, by: list[str], value: str, level: float = 0.05) -> DataFrame:
    """by, low, high: percentiles of a statistic over replicates, in proportion between two; a row a replicate."""
    return stats.groupBy(*by).agg(F.percentile(value, F.lit(level / 2)).alias("low"), F.percentile(value, F.lit(1 - level / 2)).alias("high"))


def sql(rows: str, reps: int, block: int, seed: int, values: list[str]) -> str:
    """CTEs in DuckDB SQL that end with drawn(series, replicate, size, values): every place of every replicate is drawn one by one. ``rows``: series, n (place from 0), values."""
    h = lambda part: f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', replicate, t)), {1 + 8 * part}, 8) AS BIGINT)"
    return f"""rsz AS (SELECT series, count(*) AS size FROM {rows} GROUP BY series),
rpl AS (SELECT series, size, r.range AS replicate, unnest(range(size)) AS t FROM rsz, range({reps}) r),
rst AS (SELECT *, CASE WHEN t = 0 OR {h(0)} % {block} = 0 THEN t END AS begins, {h(1)} % size AS place FROM rpl),
rbl AS (SELECT *, last_value(begins IGNORE NULLS) OVER w AS b, last_value(CASE WHEN begins IS NOT NULL THEN place END IGNORE NULLS) OVER w AS p FROM rst WINDOW w AS (PARTITION BY series, replicate ORDER BY t ROWS UNBOUNDED PRECEDING)),
drawn AS (SELECT series, replicate, size, {", ".join(f"CAST(sum(x.{v}) AS BIGINT) AS {v}" for v in values)} FROM rbl JOIN {rows} x USING (series) WHERE x.n = (p + t - b) % size GROUP BY ALL)"""
