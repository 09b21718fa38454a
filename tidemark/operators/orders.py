"""Orders and positions as expressions: charges, limit prices, fills, marks, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates of the charges on an order's value, and the flat brokerage.
STT_SELL, STAMP_BUY, EXCHANGE, SEBI, BROKERAGE, GST = 0.0015, 0.00003809524, 0.0003503, 0.00000100952, 20.0, 0.18


def charges(value: Column, is_buy: Column) -> dict[str, Column]:
    """Parts of an order's charges, and their total from unrounded parts."""
    p = {"stt": F.when(is_buy, 0.0).otherwise(value * STT_SELL), "stamp": F.when(is_buy, value * STAMP_BUY).otherwise(0.0), "exchange": value * EXCHANGE, "sebi": value * SEBI, "brokerage": F.lit(BROKERAGE)}
    p["gst"] = (p["exchange"] + p["brokerage"]) * GST
    p["total"] = p["stt"] + p["stamp"] + p["exchange"] + p["sebi"] + p["brokerage"] + p["gst"]
    return p


def limit_price(is_buy: Column, bid: Column, ask: Column, last: Column, tick: Column) -> Column:
    """Over the ask for a buy, under the bid for a sale, by a slab of the price, on the tick grid; the last price stands in for a side that is not there."""
    base = F.coalesce(F.when(is_buy, F.nullif(ask, F.lit(0.0))).otherwise(F.nullif(bid, F.lit(0.0))), F.nullif(last, F.lit(0.0)))
    off = F.when(base < 100, 0.25).when(base < 200, 0.5).when(base < 400, 1.0).otherwise(2.0)
    want = F.when(is_buy, base + off).otherwise(F.greatest(base - off, tick))
    return F.floor(want / tick + 0.5) * tick


def reject_reason(quantity: Column, lot: Column, freeze: Column, kind: Column, price: Column) -> Column:
    return (
        F.when(quantity <= 0, "quantity").when(quantity % lot != 0, "lot_size").when(quantity > freeze, "freeze_quantity")
        .when((kind == "LIMIT") & (F.coalesce(price, F.lit(0.0)) <= 0), "price")
    )


def placement_rank(is_buy: Column, is_exit: Column) -> Column:
    """Exits of sold legs free margin last; entries that are bought go before those that are sold."""
    return F.when(is_exit & ~is_buy, 1).when(~is_exit & is_buy, 2).when(is_exit & is_buy, 3).otherwise(4)


def positions(fills: DataFrame, by: list[str]) -> DataFrame:
    """by, held, entry and exit average price, realised, marked. fills: quantity, price, is_buy, status, ltp (columns)."""
    done = F.col("status").isin("COMPLETED", "PARTIAL")
    q = lambda buy: F.sum(F.when(done & (F.col("is_buy") == buy), F.col("quantity")).otherwise(0.0))
    v = lambda buy: F.sum(F.when(done & (F.col("is_buy") == buy), F.col("quantity") * F.col("price")).otherwise(0.0))
    complete = F.when(F.col("status") == "COMPLETED", F.when(F.col("is_buy"), F.col("quantity")).otherwise(-F.col("quantity"))).otherwise(0.0)
    g = fills.groupBy(*by).agg(F.sum(complete).alias("held"), q(True).alias("bq"), q(False).alias("sq"), v(True).alias("bv"), v(False).alias("sv"), F.max("ltp").alias("ltp"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "OPEN", 1)).alias("open"))
    entry, exit_ = F.try_divide("bv", "bq"), F.try_divide("sv", "sq")
    closed = F.least("bq", "sq")
    realised = F.coalesce((exit_ - entry) * closed, F.lit(0.0))
    left = F.col("bq") - F.col("sq")
    marked = F.when(F.col("ltp") > 0, F.coalesce((F.col("ltp") - F.when(left > 0, entry).otherwise(exit_)) * left, F.lit(0.0))).otherwise(0.0)
    state = F.when((F.col("bq") + F.col("sq")) == 0, "PENDING").when(F.col("open") > 0, "WORKING").when(F.col("held") == 0, "CLOSED").otherwise("OPEN")
    return g.select(*by, "held", entry.alias("entry"), exit_.alias("exit"), realised.alias("realised"), marked.alias("marked"), state.alias("state"))


# How often an order's price is moved, and how many of those may fail.
MOST_CHASES, MOST_FAILURES = 25, 3
WORKING = ("PENDING", "OPEN", "PARTIAL")


def after_market(orders: DataFrame) -> DataFrame:
    """Orders with what still works cancelled, and why."""
    works = F.col("status").isin(*WORKING)
    return orders.withColumn("reject_reason", F.when(works, "Cancelled: market closed").otherwise(F.col("reject_reason"))).withColumn("status", F.when(works, "CANCELLED").otherwise(F.col("status")))


def to_poll() -> Column:
    """At the broker and not done."""
    return F.col("status").isin("OPEN", "PARTIAL") & F.col("broker_id").isNotNull()


def to_chase(stale: Column) -> Column:
    """To be polled, meant to be chased, not too often and not with too many failures, and not touched since ``stale``."""
    return to_poll() & F.col("chase") & (F.col("attempts") < MOST_CHASES) & (F.col("failures") < MOST_FAILURES) & (F.coalesce("last_chase", "placed") < stale)


def position_states(fills: DataFrame, position: str, leg: str) -> DataFrame:
    """position, status (those marked for exit whose legs are all flat become CLOSED), shown.

    fills: a leg's orders with quantity, is_entry, status; and position_status, leg_quantity, multiplier of their position and leg.
    """
    signed = F.when(F.col("status") == "COMPLETED", F.when(F.col("is_entry"), F.col("quantity")).otherwise(-F.col("quantity"))).otherwise(0.0)
    target = F.when(F.col("position_status") == "OPEN", F.col("leg_quantity") * F.col("multiplier")).otherwise(0.0)
    legs = fills.groupBy(position, leg, "position_status").agg(F.sum(signed).alias("held"), F.max(target).alias("target"), F.bool_or(F.col("status").isin(*WORKING)).alias("working"))
    p = legs.groupBy(position, "position_status").agg(F.bool_and(F.col("held") == 0).alias("flat"), F.bool_or(F.col("held") != F.col("target")).alias("off"), F.bool_or("working").alias("working"))
    marked = F.col("position_status") == "MARKED_FOR_EXIT"
    shown = F.when(marked & ~F.col("flat"), "NOT_IN_SYNC").when((F.col("position_status") != "OPEN") & F.col("flat"), "EXITED").when(F.col("off") & F.col("working"), "IN_PROGRESS").when(F.col("off"), "NOT_IN_SYNC").otherwise("SYNCED")
    return p.select(position, F.when(marked & F.col("flat"), "CLOSED").otherwise(F.col("position_status")).alias("status"), shown.alias("shown"))
