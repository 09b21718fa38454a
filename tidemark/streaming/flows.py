"""Streams: last value per key, quotes with a time to live, news without repeats, order states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.strings import jaccard, normal_title, title_tokens


def last_values(ticks: DataFrame, key: str = "user_id", at: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """The newest value of each key; on a stream, run it in update or complete mode with a trigger as long as ticks are to be gathered."""
    return ticks.groupBy(key).agg(F.max(at).alias(at), F.max_by(value, F.struct(at, tie)).alias(value))


def quote(cached: DataFrame, stored: DataFrame, key: str, now, ttl: str = "5 seconds") -> DataFrame:
    """Each stored instrument with its cached price if that is younger than ``ttl``, else its stored one."""
    fresh = cached.where(F.col("ts") > now - F.expr(f"interval {ttl}")).select(key, F.col("value").alias("_live"))
    return stored.join(fresh, key, "left").withColumn("price", F.coalesce("_live", "price")).drop("_live")


def new_articles(news: DataFrame, key: list[str], at: str = "fetched_at", days: int = 3) -> DataFrame:
    """Articles whose key was not seen within ``days``; later repeats are dropped and old keys leave the state."""
    return news.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)


def similar_articles(titles: DataFrame, least: float = 0.7, days: int = 3) -> DataFrame:
    """a, b, similarity of titles (id, title, at) that are alike and at most ``days`` apart, as a stream joined with itself; a < b.

    Titles meet under the tokens of their prefixes in the order of the tokens' hashes, which needs no counts and so is the same in every
    micro-batch; a pair comes out under the first token that both prefixes have. The same text of a day counts once. State leaves after
    ``days``: a title that comes later than the watermark meets nothing. On a table it gives the same pairs as on any cut of it into batches.
    """
    text, tokens = normal_title(F.col("title")), title_tokens(F.col("title"))
    t = titles.withWatermark("at", f"{days} days").select("id", "at", text.alias("text"), tokens.alias("tokens")).where("text <> ''").withColumn("day", F.to_date("at"))
    t = t.dropDuplicatesWithinWatermark(["text", "day"]) if titles.isStreaming else t.groupBy("text", "day").agg(F.min_by(F.struct("id", "at", "tokens"), "id").alias("x")).select("text", "x.*")
    order = F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"])
    n = F.size("tokens")
    prefix = F.when(n > 0, F.slice(order, F.lit(1), n - F.ceil(least * n).cast("int") + 1)).otherwise(F.array(F.concat(F.lit("="), "text")))
    t = t.select("id", "at", "text", "tokens", prefix.alias("prefix")).withColumn("w", F.explode("prefix"))
    x, y = (t.select("w", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "at", "text", "tokens", "prefix"))).alias(k) for k in "xy")
    near = F.expr(f"x.w = y.w AND x_at >= y_at - INTERVAL {days} DAYS AND x_at <= y_at + INTERVAL {days} DAYS AND x_id < y_id")
    both = x.join(y, near).where(F.get(F.array_intersect("x_prefix", "y_prefix"), F.lit(0)) == F.col("x.w"))
    score = F.when(F.col("x_text") == F.col("y_text"), 1.0).otherwise(jaccard(F.col("x_tokens"), F.col("y_tokens")))
    return both.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), score.alias("similarity")).where(F.col("similarity") >= least)


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``write``; without ``every`` it takes what is there and stops."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


# What may follow what; the last three are final.
NEXT = {"": ("PENDING", "OPEN", "REJECTED"), "PENDING": ("OPEN", "REJECTED", "CANCELLED"), "OPEN": ("PARTIAL", "COMPLETED", "CANCELLED", "REJECTED"), "PARTIAL": ("PARTIAL", "COMPLETED", "CANCELLED")}
ORDER_STATE = "order_id long, status string, filled double, changes long, ignored long"


def order_states(events: DataFrame) -> DataFrame:
    """State of each order after its events (order_id, ts, seq, status, filled); repeated and impossible changes are counted and ignored, so replays do no harm.

    Rows come out for orders that an update touched; run it in update mode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, filled, changes, ignored, last = state.get if state.exists else ("", 0.0, 0, 0, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, new, amount in zip(rows["seq"], rows["status"], rows["filled"], strict=True):
            if seq <= last or new not in NEXT.get(status, ()):
                ignored += 1
                continue
            status, filled, changes, last = new, max(filled, float(amount)), changes + 1, int(seq)
        state.update((status, filled, changes, ignored, last))
        yield pd.DataFrame({"order_id": [key[0]], "status": [status], "filled": [filled], "changes": [changes], "ignored": [ignored]})

    return events.groupBy("order_id").applyInPandasWithState(step, ORDER_STATE, "status string, filled double, changes long, ignored long, last long", "update", GroupStateTimeout.NoTimeout)
