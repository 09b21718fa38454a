"""Reference tables: options near the money, merged results, stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import master as M
from ..sources.market import table
from .registry import query


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS name, DATE '2024-01-01' + CAST(7 * (p_size % 9) - 21 AS INTEGER) AS expiry, floor(p_retailprice / 5) * 5 AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS side FROM part),
n AS (SELECT name, min(expiry) AS expiry FROM c WHERE expiry >= DATE '2024-01-03' GROUP BY name), x AS (SELECT c.* FROM c JOIN n USING (name, expiry)),
g AS (SELECT name, strike - lag(strike) OVER (PARTITION BY name ORDER BY strike) AS gap FROM (SELECT DISTINCT name, strike FROM x)), s AS (SELECT name, min(gap) AS step FROM g WHERE gap > 0 GROUP BY name),
l AS (SELECT name, max(strike) - 37 AS ltp FROM c GROUP BY name), a AS (SELECT name, step, floor(ltp / step + 0.5) * step AS atm FROM s JOIN l USING (name))
SELECT id, name, expiry, strike, side, step, atm FROM x JOIN a USING (name) WHERE abs(strike - atm) <= 20 * step""")
def option_band(spark, sf) -> DataFrame:
    """Calls and puts of the nearest expiry around the money; parts stand for contracts, brands for underlyings."""
    p = table(spark, sf, "part")
    c = p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (7 * (F.col("p_size") % 9) - 21).cast("int")).alias("expiry"),
        (F.floor(F.col("p_retailprice") / 5) * 5).cast("double").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "CE").otherwise("PE").alias("side"),
    )
    spots = c.groupBy("name").agg((F.max("strike") - 37).alias("ltp"))
    return M.option_band(c, spots, F.lit("2024-01-03").cast("date"), 20).select("id", "name", "expiry", "strike", "side", "step", "atm")


@query("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, ts, event_id) AS k FROM events) WHERE k = 1""")
def first_wins_union(spark, sf) -> DataFrame:
    """Three results merged by user: the first purchase, where there is none the first view, else the first of anything."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    known = F.col("event_type").isin("purchase", "view")
    return M.first_wins([e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), e.where(~F.coalesce(known, F.lit(False)))], ["user_id"], ["ts", "event_id"])


@query("""WITH a AS (SELECT p_brand AS k, list_sort(list(DISTINCT p_type)) AS v FROM part GROUP BY 1), e AS (SELECT k, '["' || k || '",["' || array_to_string(v, '","') || '"]]' AS t FROM a)
SELECT 'av-' || substr(sha256('[' || string_agg(t, ',' ORDER BY k) || ']'), 1, 12) AS stamp FROM e""")
def alias_stamp(spark, sf) -> DataFrame:
    """The stamp of a dictionary of aliases: the types of a brand."""
    return M.dictionary_stamp(table(spark, sf, "part"), "p_brand", "p_type", "av")
