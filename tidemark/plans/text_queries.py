"""Titles, hosts, runs of an ingest; orders and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.strings import STOP_WORDS, host, matches_all, normal_title, title_tokens
from ..operators import titles
from ..operators import orders as O
from ..sources.market import table
from .registry import query, r

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9&]+', ' ', 'g'), ' +', ' ', 'g'))"
_TITLES = f"""t AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CAST(DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER) AS DATE) AS day FROM documents),
n AS (SELECT id, day, {_NORM} AS text, list_sort(list_distinct(list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})))) AS tokens FROM t)"""


def title_rows(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).alias("day"))


@query(f"WITH {_TITLES} SELECT id, text AS norm, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM n")
def normal_titles(spark, sf) -> DataFrame:
    t = title_rows(spark, sf).withColumn("k", title_tokens(F.col("title")))
    return t.select("id", normal_title(F.col("title")).alias("norm"), F.size("k").cast("long").alias("n_tokens"), F.array_join("k", " ").alias("tokens"))


_CLASSES = "c AS (SELECT min(id) AS id, day, text, any_value(tokens) AS tokens FROM n WHERE text <> '' GROUP BY text, day)"


@query(f"""WITH {_TITLES}, {_CLASSES}, p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.text = b.text THEN 1.0::DOUBLE WHEN len(a.tokens) + len(b.tokens) = 0 THEN 0 ELSE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens)))::DOUBLE END AS s
  FROM c a JOIN c b ON a.id < b.id AND abs(a.day - b.day) <= 3) SELECT a, b, {r('s')} AS similarity FROM p WHERE s >= 0.7""")
def similar_titles(spark, sf) -> DataFrame:
    """Pairs of classes of equal titles of a day that are alike; which title is in which class is ``title_classes``."""
    return titles.similar_pairs(title_rows(spark, sf)).select("a", "b", half_up(F.col("similarity")).alias("similarity"))


@query(f"WITH {_TITLES}, {_CLASSES} SELECT n.id, coalesce(c.id, n.id) AS cls FROM n LEFT JOIN c USING (text, day)")
def title_classes(spark, sf) -> DataFrame:
    return titles.title_classes(title_rows(spark, sf)).select("id", "cls")


@query()
def accepted_titles(spark, sf) -> DataFrame:
    """Titles that stay when each is dropped that is alike to an accepted one before it."""
    t = title_rows(spark, sf)
    return titles.accept_in_order(t, titles.similar_pairs(t))


_ALIASES = [("THE", "the", "of"), ("AND", "and", None), ("ON", "on the", None), ("DE", "de la", None), ("DER", "der", "die")]


@query("WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS s FROM documents), x AS (SELECT doc_id, [" + ", ".join(
    f"CASE WHEN regexp_matches({'regexp_replace(lower(s), ' + chr(39) + '(^|[^a-z0-9])' + p.replace(' ', chr(92) + 's+') + chr(92) + 's+' + x + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' if x else 'lower(s)'}, '(^|[^a-z0-9]){p.replace(' ', chr(92) + 's+')}($|[^a-z0-9])') THEN '{s}' END" for s, p, x in _ALIASES) + "] AS l FROM t) SELECT doc_id, array_to_string(list_filter(l, lambda v: v IS NOT NULL), ',') AS symbols FROM x")
def symbols_in_titles(spark, sf) -> DataFrame:
    """Which aliases a first line names; an alias with a word that must not follow does not count there."""
    d = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("s"))
    return d.select("doc_id", F.array_join(titles.named_symbols(F.col("s"), _ALIASES), ",").alias("symbols"))


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'wid')")
def token_search(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where(matches_all(F.col("p_name"), "RED-wid")).select("p_partkey", "p_name")


@query("SELECT sha256(props) AS sha, count(*) AS seen, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def raw_capture(spark, sf) -> DataFrame:
    """Payloads by content: how often and when each was seen."""
    return table(spark, sf, "events").groupBy(F.sha2("props", 256).alias("sha")).agg(F.count(F.lit(1)).alias("seen"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("""WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, n < 60 AS low, coalesce(lag(n < 60) OVER (PARTITION BY event_type ORDER BY day), false) AS low_before FROM g)
SELECT event_type, day, n, CASE WHEN low AND low_before THEN 'alert' WHEN low THEN 'watch' ELSE 'ok' END AS status FROM l""")
def ingest_alerts(spark, sf) -> DataFrame:
    """A source is on watch when a run brings little, and alerts on the second such run in a row."""
    g = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    low = F.col("n") < 60
    before = F.coalesce(F.lag(low).over(Window.partitionBy("event_type").orderBy("day")), F.lit(False))
    return g.withColumn("b", before).select("event_type", "day", "n", F.when(low & F.col("b"), "alert").when(low, "watch").otherwise("ok").alias("status"))


@query("SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id")
def last_ticks(spark, sf) -> DataFrame:
    """The last value of each key, which is what a stream of ticks settles to."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, dayname(ts + INTERVAL 330 MINUTE) NOT IN ('Saturday', 'Sunday') AND (hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE)) BETWEEN 555 AND 930 AS open FROM events""")
def market_hours(spark, sf) -> DataFrame:
    """Whether an event falls in the exchange's hours, Monday to Friday 09:15 to 15:30 in India."""
    t = F.col("ts") + F.expr("interval 330 minutes")
    return table(spark, sf, "events").select("event_id", ((F.weekday(t) < 5) & (F.hour(t) * 60 + F.minute(t)).between(555, 930)).alias("open"))


_BUY = "(l_returnflag <> 'R')"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, {_BUY} AS buy FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {r('CASE WHEN buy THEN 0 ELSE v * 0.0015::DOUBLE END')} AS stt, {r('v * 0.0003503::DOUBLE')} AS exchange,
 {r('CASE WHEN buy THEN 0 ELSE v * 0.0015::DOUBLE END + CASE WHEN buy THEN v * 0.00003809524::DOUBLE ELSE 0 END + v * 0.0003503::DOUBLE + v * 0.00000100952::DOUBLE + 20 + (v * 0.0003503::DOUBLE + 20) * 0.18::DOUBLE', 3)} AS total FROM x""")
def order_charges(spark, sf) -> DataFrame:
    p = O.charges(F.col("l_extendedprice"), F.col("l_returnflag") != "R")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", half_up(p["stt"]).alias("stt"), half_up(p["exchange"]).alias("exchange"), half_up(p["total"], 3).alias("total"))


@query(f"""WITH x AS (SELECT p_partkey, p_size % 2 = 0 AS buy, CASE WHEN p_size % 5 > 0 THEN p_retailprice - 0.1 END AS bid, CASE WHEN p_size % 7 > 0 THEN p_retailprice + 0.1 END AS ask, p_retailprice AS last FROM part),
b AS (SELECT *, coalesce(CASE WHEN buy THEN ask ELSE bid END, last) AS base FROM x), o AS (SELECT *, CASE WHEN base < 100 THEN 0.25 WHEN base < 200 THEN 0.5 WHEN base < 400 THEN 1 ELSE 2 END::DOUBLE AS off FROM b)
SELECT p_partkey, {r('floor(CASE WHEN buy THEN base + off ELSE greatest(base - off, 0.05::DOUBLE) END / 0.05::DOUBLE + 0.5) * 0.05::DOUBLE', 2)} AS price FROM o""")
def limit_prices(spark, sf) -> DataFrame:
    last = F.col("p_retailprice")
    bid, ask = F.when(F.col("p_size") % 5 > 0, last - 0.1), F.when(F.col("p_size") % 7 > 0, last + 0.1)
    return table(spark, sf, "part").select("p_partkey", half_up(O.limit_price(F.col("p_size") % 2 == 0, bid, ask, last, F.lit(0.05)), 2).alias("price"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 0 THEN 'quantity' WHEN l_quantity % 5 <> 0 THEN 'lot_size' WHEN l_quantity > 40 THEN 'freeze_quantity' END AS reason,
 CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 WHEN l_linestatus <> 'F' AND l_returnflag <> 'R' THEN 2 WHEN l_linestatus = 'F' THEN 3 ELSE 4 END AS rank FROM lineitem""")
def order_checks(spark, sf) -> DataFrame:
    """Why an order would be rejected, and its place in the order of placement."""
    buy, out = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F"
    why = O.reject_reason(F.col("l_quantity"), F.lit(5.0), F.lit(40.0), F.lit("MARKET"), F.lit(None).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", why.alias("reason"), O.placement_rank(buy, out).alias("rank"))


@query(f"""WITH f AS (SELECT o_custkey, l_partkey, l_quantity AS q, l_extendedprice / l_quantity AS p, {_BUY} AS buy, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PARTIAL' ELSE 'OPEN' END AS st, p_retailprice AS ltp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
g AS (SELECT o_custkey, l_partkey, sum(CASE WHEN st = 'COMPLETED' THEN CASE WHEN buy THEN q ELSE -q END ELSE 0 END) AS held, coalesce(sum(q) FILTER (WHERE st <> 'OPEN' AND buy), 0) AS bq, coalesce(sum(q) FILTER (WHERE st <> 'OPEN' AND NOT buy), 0) AS sq,
  sum(q * p) FILTER (WHERE st <> 'OPEN' AND buy) AS bv, sum(q * p) FILTER (WHERE st <> 'OPEN' AND NOT buy) AS sv, max(ltp) AS ltp, count(*) FILTER (WHERE st = 'OPEN') AS op FROM f GROUP BY o_custkey, l_partkey)
SELECT o_custkey, l_partkey, held, {r('bv / nullif(bq, 0)', 3)} AS entry, {r('sv / nullif(sq, 0)', 3)} AS exit, {r('coalesce((sv / nullif(sq, 0) - bv / nullif(bq, 0)) * least(bq, sq), 0)', 2)} AS realised,
 {r('CASE WHEN ltp > 0 THEN coalesce((ltp - CASE WHEN bq > sq THEN bv / nullif(bq, 0) ELSE sv / nullif(sq, 0) END) * (bq - sq), 0) ELSE 0 END', 2)} AS marked, CASE WHEN bq + sq = 0 THEN 'PENDING' WHEN op > 0 THEN 'WORKING' WHEN held = 0 THEN 'CLOSED' ELSE 'OPEN' END AS state FROM g""")
def account_positions(spark, sf) -> DataFrame:
    """Fills of an account in an instrument, marked with the instrument's own price."""
    li, o, p = (table(spark, sf, x) for x in ("lineitem", "orders", "part"))
    f = li.where("l_quantity > 0").join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    f = f.select("o_custkey", "l_partkey", F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_returnflag") != "R").alias("is_buy"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("OPEN").alias("status"), F.col("p_retailprice").alias("ltp"))
    x = O.positions(f, ["o_custkey", "l_partkey"])
    return x.select("o_custkey", "l_partkey", "held", half_up(F.col("entry"), 3).alias("entry"), half_up(F.col("exit"), 3).alias("exit"), half_up(F.col("realised"), 2).alias("realised"), half_up(F.col("marked"), 2).alias("marked"), "state")


@query("""WITH s AS (SELECT DISTINCT p_brand, floor(p_retailprice / 5) * 5 AS strike FROM part), g AS (SELECT *, strike - lag(strike) OVER (PARTITION BY p_brand ORDER BY strike) AS gap FROM s),
b AS (SELECT p_brand, min(gap) AS step, avg(strike) AS ltp FROM g GROUP BY p_brand HAVING min(gap) > 0), a AS (SELECT *, floor(ltp / step + 0.5) * step AS atm FROM b)
SELECT s.p_brand, strike FROM s JOIN a USING (p_brand) WHERE abs(strike - atm) <= 3 * step""")
def strike_band(spark, sf) -> DataFrame:
    """Strikes within three steps of the one at the money; a step is the smallest gap between strikes."""
    s = table(spark, sf, "part").select("p_brand", (F.floor(F.col("p_retailprice") / 5) * 5).cast("double").alias("strike")).distinct()
    g = s.withColumn("gap", F.col("strike") - F.lag("strike").over(Window.partitionBy("p_brand").orderBy("strike")))
    a = g.groupBy("p_brand").agg(F.min("gap").alias("step"), F.avg("strike").alias("ltp")).where("step > 0").withColumn("atm", F.floor(F.col("ltp") / F.col("step") + 0.5) * F.col("step"))
    return s.join(a, "p_brand").where(F.abs(F.col("strike") - F.col("atm")) <= 3 * F.col("step")).select("p_brand", "strike")
