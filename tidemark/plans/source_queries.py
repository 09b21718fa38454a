"""Readers and rules over text made of the tables: what is read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import SECTORS, of_domains, sector_name, site, western_units
from ..operators import orders as O
from ..operators import titles
from ..sources import files
from ..sources.market import table
from ..streaming import flows
from .registry import query, r

_SUPPLIER_DAY = "CAST(l_shipdate AS DATE)"


@query(f"""SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_linenumber % 4 <> 3 THEN {_SUPPLIER_DAY} END AS trade_date, floor(l_extendedprice) AS close, CASE WHEN l_quantity % 2 = 0 THEN l_quantity ELSE 0 END AS volume, floor(l_extendedprice) AS prev_close,
  CASE WHEN l_linenumber % 4 = 2 THEN 'series' WHEN l_linenumber % 4 = 3 THEN 'date' WHEN l_quantity = 7 THEN 'price' WHEN l_quantity = 8 THEN 'delivered' END AS reason FROM lineitem""")
def daily_file_rows(spark, sf) -> DataFrame:
    """The exchange's daily file: a line for each line item, some of another series, without a date, with high under low, or with more delivered than traded."""
    p, q, k = F.floor("l_extendedprice").cast("string"), F.col("l_quantity"), F.col("l_linenumber") % 4
    day = F.when(k == 3, "n/a").otherwise(F.date_format("l_shipdate", "dd-MMM-yyyy"))
    cells = [F.concat(F.lit("s"), F.col("l_suppkey"), F.lit("-eq")), F.when(k == 2, "BE").otherwise("EQ"), day, F.lit("-"), p, F.when(q == 7, "1").otherwise(p), p, p, p, p, F.when(q % 2 == 0, q.cast("int").cast("string")).otherwise("-"), F.lit("5"), F.lit("2"), F.lit("4"), F.when(q == 8, "140").otherwise("40.5")]
    lines = table(spark, sf, "lineitem").select(F.concat(F.concat_ws(", ", *cells), F.lit("\r")).alias("value"))
    return files.daily_file(lines).select("symbol", "trade_date", "close", "volume", "prev_close", "reason")


@query("SELECT p_partkey AS id, p_name || ' & co <1>' AS title, 'http://x/' || p_partkey AS link, 'd' || p_size AS published FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, p_brand, 'http://y/' || p_partkey, NULL FROM part WHERE p_partkey % 3 = 0")
def feed_rows(spark, sf) -> DataFrame:
    """Items of feeds in XML: one in RSS with its title unwrapped and decoded, none without a link, a second one by its guid."""
    i = F.col("p_partkey").cast("string")
    rss = F.concat(F.lit("<item><title><![CDATA["), "p_name", F.lit(" &amp; <b>co</b> &lt;1&gt;]]></title>"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("<link>http://x/"), i, F.lit("</link>"))).otherwise(""), F.lit("<pubDate> d"), F.col("p_size").cast("string"), F.lit(" </pubDate></item>"))
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<item><title>"), "p_brand", F.lit("</title><guid>http://y/"), i, F.lit("</guid></item>"))).otherwise("")
    return files.feed_items(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<rss>"), rss, more, F.lit("</rss>")).alias("payload"))).select("id", "title", "link", "published")


@query("SELECT CAST(c_custkey AS VARCHAR) AS scrip, 'H & ' || c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' — ' || 'more' ELSE c_name END AS body, TIMESTAMP '2024-01-05 10:00:00' AS published FROM customer WHERE c_custkey % 7 > 1")
def announcement_rows(spark, sf) -> DataFrame:
    """Announcements in JSON; the sentence for "none" and a broken payload give nothing."""
    row = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("SLONGNAME"), F.when(F.col("c_custkey") % 2 == 0, " more ").otherwise("").alias("MORE"), F.concat(F.lit("H &amp; "), "c_mktsegment").alias("HEADLINE"), F.lit("2024-01-05T10:00:00").alias("NEWS_DT"), F.col("c_custkey").cast("string").alias("SCRIP_CD"))).alias("Table")))
    payload = F.when(F.col("c_custkey") % 7 == 0, '"No Record Found!"').when(F.col("c_custkey") % 7 == 1, "{broken").otherwise(row)
    return files.announcements(table(spark, sf, "customer").select(payload.alias("payload"))).select("scrip", "title", "body", "published")


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 4 THEN CAST(c_custkey AS VARCHAR) END AS scrip, CASE WHEN c_custkey % 5 = 4 THEN c_name ELSE 'A & ' || c_mktsegment END AS title,
  CASE WHEN c_custkey % 5 <> 4 THEN c_name || CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN ' — A & ' || c_mktsegment ELSE ' — more' END END AS body,
  CASE WHEN c_custkey % 5 = 4 THEN 'http://x/' || c_custkey WHEN c_custkey % 3 = 0 THEN '{files.ATTACHMENTS}' || c_custkey || '.pdf' ELSE '' END AS url, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-05 10:00:00' END AS published
FROM customer WHERE c_custkey % 7 > 1""")
def announcement_feeds(spark, sf) -> DataFrame:
    """Announcements in all their shapes: a table or an array in JSON, rows in XML, plain feeds; fields under their other names, stamps that are none, windows without any."""
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    at, file = F.when(F.col("c_custkey") % 4 > 0, "2024-01-05T10:00:00").otherwise("soon"), F.when(F.col("c_custkey") % 3 == 0, F.concat(key, F.lit(".pdf"))).otherwise(" ")
    title = F.concat(F.lit("A &amp; "), "c_mktsegment")
    row = lambda head, when, *more: F.struct(F.col("c_name").alias("SLONGNAME"), title.alias(head), at.alias(when), key.alias("SCRIP_CD"), file.alias("ATTACHMENTNAME"), *more)
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
    xml = lambda head, t: F.concat(F.lit('<NewDataSet>\n<Table diffgr:id="1">'), tag("slongname", F.col("c_name")), tag(head, title), tag("MORE", F.lit(" <b>more</b> ")), tag("DT_TM", at), tag("SCRIP_CD", key), tag(t, file), F.lit("</Table></NewDataSet>"))
    rss = F.concat(F.lit("<rss><item>"), tag("title", F.col("c_name")), tag("link", F.concat(F.lit("http://x/"), key)), tag("pubDate", at), F.lit("</item></rss>"))
    shape = F.when(k == 0, F.to_json(F.struct(F.array(row("HEADLINE", "NEWS_DT")).alias("Table")))).when(k == 1, F.to_json(F.array(row("NEWSSUB", "DissemDT")))).when(k == 2, xml("HEADLINE", "ATTACHMENTNAME")).when(k == 3, xml("NEWS_SUB", "AttachmentName")).otherwise(rss)
    payload = F.when(F.col("c_custkey") % 7 == 0, '"No Record Found!"').when(F.col("c_custkey") % 7 == 1, "[broken").otherwise(F.concat(F.lit("\n "), shape))
    return files.announcements(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), payload.alias("payload")))


def _archive(spark, sf) -> DataFrame:
    """win, payload: a user's events as an archive would list them; every fifth window is an error page, every seventh holds nothing."""
    e, bad = table(spark, sf, "events"), F.col("event_id") % 11
    stamp = F.when(bad == 1, "20240230T000000Z").when(bad == 2, "20240105T240000Z").when(bad == 3, "2024-01-05").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    article = F.concat(F.lit('{"url":'), F.when(bad == 4, "7").otherwise(quoted(F.concat(F.lit(" u"), F.col("event_id").cast("string")))), F.lit(',"title":'), F.when(bad == 5, quoted(F.lit("  "))).otherwise(quoted(F.concat("event_type", F.lit(" , "), F.col("user_id").cast("string"), F.lit(" %")))),
                       F.lit(',"seendate":'), quoted(stamp), F.when(bad == 6, F.lit(',"domain":null')).otherwise(',"domain":"x.in"'), F.lit("}"))
    g = e.groupBy(F.col("user_id").alias("win")).agg(F.array_join(F.sort_array(F.collect_list(article)), ",").alias("a"))
    payload = F.when(F.col("win") % 5 == 0, "<html>Please limit requests</html>").when(F.col("win") % 7 == 0, F.when(F.col("win") % 2 == 0, "{}").otherwise('{"articles":[]}')).otherwise(F.concat(F.lit('{"articles":['), "a", F.lit("]}")))
    return g.select("win", payload.alias("payload"))


@query("SELECT user_id AS win, CASE WHEN user_id % 5 = 0 THEN 'failed' WHEN user_id % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(CASE WHEN user_id % 5 = 0 OR user_id % 7 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS articles FROM events GROUP BY user_id")
def archive_window_states(spark, sf) -> DataFrame:
    """A window that failed is told from one in which nothing was published."""
    return files.archive_windows(_archive(spark, sf))


@query("""SELECT user_id AS win, 'u' || event_id AS url, event_type || ', ' || user_id || '%' AS title, CASE WHEN event_id % 11 = 6 THEN '' ELSE 'x.in' END AS domain, date_trunc('second', ts) AS published, date_trunc('second', ts) + INTERVAL 15 MINUTE AS available_at
FROM events WHERE user_id % 5 > 0 AND user_id % 7 > 0 AND event_id % 11 NOT IN (1, 2, 3, 4, 5)""")
def archive_window_articles(spark, sf) -> DataFrame:
    """Articles of the windows with the moment from which research may know them; impossible days, numbers for addresses and empty titles are left out."""
    return files.archive_articles(_archive(spark, sf), latency_minutes=15)


@query("SELECT 'u' || event_id % 500 AS url, 'click.in' AS domain, arg_min(title, (seen, title)) AS title, min(seen) AS seen FROM (SELECT *, 'E ' || user_id || ', x' AS title, date_trunc('second', ts) AS seen FROM events) WHERE event_id % 500 >= 100 AND event_type = 'click' GROUP BY 1")
def new_archive_records(spark, sf) -> DataFrame:
    """Records of a media archive in JSON lines: each address once, the earliest, and only those that are not known yet."""
    e = table(spark, sf, "events").where("event_type = 'click'")
    url = F.concat(F.lit("u"), (F.col("event_id") % 500).cast("string"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("date"), url.alias("url"), F.lit("CLICK.IN").alias("domain"), F.concat(F.lit("E "), F.col("user_id").cast("string"), F.lit(" , x")).alias("title")))
    known = spark.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    return files.first_seen(files.archive_records(e.select(line.alias("value"))), known).select("url", "domain", "title", "seen")


def _little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


@query("SELECT CAST(user_id AS VARCHAR) AS instrument_token, floor(value * 100 + 0.5) / 100 AS ltp, event_id AS volume, floor(value * 100 + 0.5) / 100 AS bid, floor(value * 100 + 0.5) / 100 AS ask FROM events WHERE value >= 0")
def tick_frames(spark, sf) -> DataFrame:
    """Binary ticks without depth, decoded: both sides fall back to the price."""
    e = table(spark, sf, "events").where("value >= 0")
    token = F.rpad(F.hex(F.col("user_id").cast("string").cast("binary")), 50, "0")
    frame = F.unhex(F.concat(F.lit("0000"), token, F.lit("00" * 16), _little_endian(F.floor(F.col("value") * 100 + 0.5)), F.lit("00" * 16), _little_endian(F.col("event_id"))))
    return files.ticks(e.select(frame.alias("frame")))


@query("""WITH p AS (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) + 1000 AS paise FROM events WHERE value >= 0)
SELECT CAST(user_id AS VARCHAR) AS instrument_token, paise / 100 AS ltp, event_id AS volume, CASE WHEN event_id % 3 > 0 THEN (paise - 5) / 100 ELSE (paise - 15) / 100 END AS bid, CASE WHEN event_id % 4 = 0 THEN paise / 100 ELSE (paise + 5) / 100 END AS ask FROM p""")
def tick_depth(spark, sf) -> DataFrame:
    """Binary ticks with depth: the first level of a side that has a quantity counts; where no seller has a price, the last one does."""
    e = table(spark, sf, "events").where("value >= 0").withColumn("paise", F.floor(F.col("value") * 100 + 0.5).cast("long") + 1000)
    token, n = F.rpad(F.hex(F.col("user_id").cast("string").cast("binary")), 50, "0"), F.col("event_id")
    level = lambda side, quantity, price: F.concat(F.lit(side), _little_endian(quantity), _little_endian(price), F.lit("0000"))
    buy, sell = "0100", "0000"
    depth = F.concat(level(buy, n % 3, F.col("paise") - 5), level(buy, F.lit(10), F.col("paise") - 15), level(sell, F.lit(3), F.when(n % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("paise") + 5)))
    frame = F.unhex(F.concat(F.lit("0000"), token, F.lit("00" * 16), _little_endian(F.col("paise")), F.lit("00" * 16), _little_endian(n), F.lit("00" * 72), depth))
    return files.ticks(e.select(frame.alias("frame")))


@query("""WITH s AS (SELECT CAST(p_size % 4 AS VARCHAR) AS label, p_brand AS symbol, max(p_type) AS sector FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL), f AS (SELECT symbol, arg_max(sector, label) AS sector, list(label) AS own FROM s GROUP BY symbol)
SELECT symbol, sector, (SELECT min(label) FROM (SELECT DISTINCT label FROM s) l WHERE label > '0' AND NOT list_contains(own, label)) AS exit_label FROM f WHERE list_contains(own, '0')""")
def snapshot_cohort(spark, sf) -> DataFrame:
    """Names of the first snapshot, with the first later one that is without them."""
    s = table(spark, sf, "part").where("p_partkey % 3 > 0").groupBy((F.col("p_size") % 4).cast("string").alias("label"), F.col("p_brand").alias("symbol")).agg(F.max("p_type").alias("sector"))
    return files.cohort(s, "0")


# Titles and bodies that customers' numbers stand for: a label decides, else the title.
_TITLES = (
    "Unaudited financial results for the quarter", "Transcript of earnings call", "Company bags an order from railways", "CRISIL reaffirms rating", "Acquisition of a subsidiary", "Interim dividend declared", "Outcome of board meeting",
    "Closure of trading window under insider trading code", "Disclosure of pledge", "Appointment of director", "Allotment of equity shares", "Newspaper publication", "General update", "Sale of its business division",
)
_BODIES = (None, "Announcement under Regulation 30 (LODR)-Credit Rating", None, "Announcement under Regulation 30 (LODR)-Updates on something", "no label", "x (LODR) - Press Release / Media Release | y")


def _kind_sql(x: str, rules: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for p, k in rules) + " END"


_TYPED = f"""WITH t AS (SELECT c_custkey, [{", ".join(f"'{x}'" for x in _TITLES)}][1 + c_custkey % {len(_TITLES)}] AS title, [{", ".join("NULL" if x is None else f"'{x}'" for x in _BODIES)}][1 + c_custkey % 11 % {len(_BODIES)}] AS body FROM customer),
l AS (SELECT *, nullif(trim(regexp_extract(coalesce(body, ''), '(?i)\\(LODR\\)\\s*-\\s*([^\\n|]{{2,80}})', 1)), '') AS label FROM t),
k AS (SELECT *, {_kind_sql('label', titles.LABEL_RULES)} AS by_label, {_kind_sql('title', titles.TITLE_RULES)} AS by_title FROM l)
SELECT c_custkey, CASE WHEN label IS NOT NULL THEN coalesce(by_label, 'OTHER') ELSE coalesce(by_title, 'OTHER') END AS kind, CASE WHEN label IS NOT NULL THEN 'exchange-label' WHEN by_title IS NOT NULL THEN 'keyword' ELSE 'none' END AS method, label, 'ev-1.1.0' AS version FROM k"""


@query(_TYPED)
def typed_events(spark, sf) -> DataFrame:
    """Kind of a filing by the exchange's label, else by its title."""
    c = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (1 + at % len(xs)).cast("int"))
    t = table(spark, sf, "customer").select("c_custkey", pick(_TITLES, c).alias("title"), pick(_BODIES, c % 11).alias("body"))
    return t.select("c_custkey", *(x.alias(n) for n, x in titles.event_type(F.col("title"), F.col("body")).items()))


@query(f"SELECT kind, method, count(*) AS n FROM ({_TYPED}) GROUP BY ALL")
def typing_coverage(spark, sf) -> DataFrame:
    """How many filings were typed, by kind and method."""
    return typed_events(spark, sf).groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n"))


# Sites of the news of a country that are not under its domain.
NEWS_DOMAINS = (
    "economictimes.indiatimes.com", "moneycontrol.com", "thehindubusinessline.com", "livemint.com", "financialexpress.com", "business-standard.com", "cnbctv18.com", "indiainfoline.com", "indiablooms.com", "equitybulls.com", "vccircle.com", "forbesindia.com",
    "dealstreetasia.com", "zeebiz.com", "domain-b.com", "biospectrumindia.com", "petrowatch.com", "timesofindia.indiatimes.com", "indiatimes.com", "thehindu.com", "ndtv.com", "news18.com", "indianexpress.com", "newindianexpress.com", "hindustantimes.com",
    "rediff.com", "dnaindia.com", "tribuneindia.com", "zeenews.india.com", "india.com", "indiatvnews.com", "jagranjosh.com", "deccanchronicle.com", "deccanherald.com", "thestatesman.com", "siasat.com", "sakshipost.com", "firstpost.com", "outlookindia.com",
    "mid-day.com", "timesnownews.com", "oneindia.com", "prokerala.com", "newkerala.com", "udaipurkiran.com", "webindia123.com", "dailyexcelsior.com", "centralchronicle.com", "orissadiary.com", "orissapost.com", "pragativadi.com", "thehitavada.com",
    "sentinelassam.com", "theshillongtimes.com", "morungexpress.com", "nagalandpost.com", "kashmirreader.com", "kashmirlife.net", "rashtranews.com", "latestly.com", "siliconindia.com", "chennaionline.com", "mangalorean.com", "mathrubhumi.com",
    "dailypioneer.com", "devdiscourse.com", "barandbench.com", "medianama.com", "adgully.com", "afaqs.com", "bestmediainfo.com", "yourstory.com", "fonearena.com", "infotechlead.com", "telecomlead.com", "technuter.com", "greentechlead.com",
    "themobileindian.com", "franchiseindia.com", "magicbricks.com", "organiser.org", "openthemagazine.com", "gulte.com", "bilkulonline.com", "newstodaynet.com", "cobrapost.com", "rozanaspokesman.com", "educationtimes.com", "theindianawaaz.com",
    "rushlane.com", "zigwheels.com", "team-bhp.com", "autocarindia.com", "carandbike.com", "cartrade.com", "indianautosblog.com",
)
_ADDRESSES = ("https://www.", "http://auto.", "", "HTTPS://x")


@query(f"""WITH u AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _ADDRESSES)}][1 + p_partkey % 4] || [{", ".join(f"'{x}'" for x in NEWS_DOMAINS)}, 'news.co.in', 'example.com', 'bbc.co.uk'][1 + p_partkey * 7 % {len(NEWS_DOMAINS) + 3}] || ':443/a?b' AS url FROM part),
h AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '^[^/?:]*', 0) AS site FROM u), s AS (SELECT *, string_split(site, '.') AS parts FROM h)
SELECT p_partkey, site, site = 'in' OR suffix(site, '.in') OR len(list_intersect(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.')), [{", ".join(f"'{x}'" for x in NEWS_DOMAINS)}])) > 0 AS home FROM s""")
def news_domains(spark, sf) -> DataFrame:
    """Whether an address is of the country's news."""
    p = F.col("p_partkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (1 + at % len(xs)).cast("int"))
    u = table(spark, sf, "part").select("p_partkey", F.concat(pick(_ADDRESSES, p), pick((*NEWS_DOMAINS, "news.co.in", "example.com", "bbc.co.uk"), p * 7), F.lit(":443/a?b")).alias("url")).withColumn("site", site(F.col("url")))
    return u.select("p_partkey", "site", of_domains(F.col("site"), NEWS_DOMAINS).alias("home"))


@query("SELECT c_mktsegment AS label, CASE upper(trim(c_mktsegment)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTORS.items()) + " ELSE trim(c_mktsegment) END AS sector, count(*) AS n FROM customer GROUP BY ALL")
def sector_labels(spark, sf) -> DataFrame:
    """Industry labels by the sector they count as."""
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n")).select("label", sector_name(F.col("label")).alias("sector"), "n")


@query("""SELECT p_partkey, 'INR ' || CASE WHEN p_size * 10 >= 1000 THEN printf('%.2f billion', p_size * 10 / 1000.0::DOUBLE) ELSE printf('%.2f million', p_size * 10.0::DOUBLE) END || ' net profit up ' || p_size || '% year-on-year, ' || CASE WHEN p_size * 100 >= 1000 THEN printf('%.2f billion', p_size * 100 / 1000.0::DOUBLE) ELSE printf('%.2f million', p_size * 1000 * 0.1::DOUBLE) END || ' shares in Q2 fiscal year 25' AS text FROM part""")
def western_amounts(spark, sf) -> DataFrame:
    """Amounts and terms of Indian business English in plain English."""
    n = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", western_units(F.concat(F.lit(" Rs "), n, F.lit(" crore  PAT up "), n, F.lit("% yoy, "), n, F.lit(",000 lakh shares in Q2FY25"))).alias("text"))


@query(f"""WITH q AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id), n AS (SELECT max(ts) - INTERVAL 1 DAY AS since FROM events)
SELECT s_suppkey AS user_id, {r('CASE WHEN q.ts > n.since THEN q.value ELSE s_acctbal END', 2)} AS price FROM supplier CROSS JOIN n LEFT JOIN q ON q.user_id = s_suppkey""")
def live_quotes(spark, sf) -> DataFrame:
    """The cached price where it is young enough, else the stored one."""
    from ..functions.numbers import half_up

    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    stored = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_acctbal").alias("price"))
    cached = flows.last_values(e).crossJoin(F.broadcast(now))
    return flows.quote(cached, stored, "user_id", F.col("now"), "1 day").select("user_id", half_up(F.col("price"), 2).alias("price"))


# ---------------------------------------------------------------- orders

@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'CANCELLED' ELSE 'COMPLETED' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'Cancelled: market closed' END AS reject_reason FROM orders""")
def closed_orders(spark, sf) -> DataFrame:
    """Orders after the market has closed: what still works is cancelled."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("OPEN").alias("status"), F.lit(None).cast("string").alias("reject_reason"))
    return O.after_market(o)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS works, o_custkey % 3 > 0 AS sent, o_orderkey % 2 = 0 AS chase, o_orderkey % 30 AS attempts, o_orderkey % 5 AS failures, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS last_chase, o_orderdate AS placed FROM orders)
SELECT o_orderkey, works AND sent AS poll, works AND sent AND chase AND attempts < 25 AND failures < 3 AND coalesce(last_chase, placed) < TIMESTAMP '1995-06-01' AS chase FROM o""")
def pollable_orders(spark, sf) -> DataFrame:
    """Which orders are asked about, and which have their price moved after the market."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("OPEN").alias("status"), F.when(F.col("o_custkey") % 3 > 0, k.cast("string")).alias("broker_id"), (k % 2 == 0).alias("chase"),
                                          (k % 30).alias("attempts"), (k % 5).alias("failures"), F.when(k % 4 != 0, F.col("o_orderdate")).alias("last_chase"), F.col("o_orderdate").alias("placed"))
    return o.select("o_orderkey", O.to_poll().alias("poll"), O.to_chase(F.lit("1995-06-01").cast("timestamp")).alias("chase"))


_LEGS = """lg AS (SELECT o_custkey AS position, l_suppkey % 3 AS leg, CASE o_custkey % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'MARKED_FOR_EXIT' ELSE 'CLOSED' END AS pstatus, sum(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END ELSE 0 END) AS held,
  CASE WHEN o_custkey % 3 = 0 THEN 50.0::DOUBLE * (1 + o_custkey % 2) ELSE 0 END AS target, bool_or(o_orderstatus IN ('O', 'P')) AS working FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(f"""WITH {_LEGS}, p AS (SELECT position, pstatus, bool_and(held = 0) AS flat, bool_or(held <> target) AS off, bool_or(working) AS working FROM lg GROUP BY ALL)
SELECT position, CASE WHEN pstatus = 'MARKED_FOR_EXIT' AND flat THEN 'CLOSED' ELSE pstatus END AS status, CASE WHEN pstatus = 'MARKED_FOR_EXIT' AND NOT flat THEN 'NOT_IN_SYNC' WHEN pstatus <> 'OPEN' AND flat THEN 'EXITED' WHEN off AND working THEN 'IN_PROGRESS' WHEN off THEN 'NOT_IN_SYNC' ELSE 'SYNCED' END AS shown FROM p""")
def position_states(spark, sf) -> DataFrame:
    """Positions of three legs: those marked for exit whose legs are flat are closed; and what is shown of each."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("OPEN")
    fills = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("position"), (F.col("l_suppkey") % 3).alias("leg"), F.when(F.col("o_custkey") % 3 == 0, "OPEN").when(F.col("o_custkey") % 3 == 1, "MARKED_FOR_EXIT").otherwise("CLOSED").alias("position_status"),
                                                             F.lit(50.0).alias("leg_quantity"), (1 + F.col("o_custkey") % 2).alias("multiplier"), "l_quantity", (F.col("l_returnflag") != "R").alias("is_entry"), status.alias("status"))
    return O.position_states(fills.withColumnRenamed("l_quantity", "quantity"), "position", "leg")


_MASTER = """WITH d AS (SELECT p_partkey AS k, p_size % 5 AS kind, p_brand AS name, p_retailprice AS v FROM part)
SELECT CASE WHEN kind < 2 THEN 'NSE:N' || k || '-EQ' ELSE CASE kind WHEN 2 THEN 'NFO:N' ELSE 'NSE:N' END || k END AS id, CAST(k AS VARCHAR) AS token, CASE WHEN kind < 2 THEN 'N' || k || '-EQ' ELSE 'N' || k END AS symbol, name,
  CASE WHEN kind = 2 THEN DATE '2026-01-29' END AS expiry, CASE WHEN kind = 2 THEN floor(v) ELSE 0 END AS strike, CASE WHEN kind = 0 THEN 1 ELSE 25 END AS lot, CASE WHEN kind < 2 THEN 0.05::DOUBLE ELSE 5 END AS tick, CASE kind WHEN 2 THEN 'OPTIDX' WHEN 3 THEN 'AMXIDX' ELSE 'EQ' END AS kind,
  CASE WHEN kind < 2 THEN 'sector of ' || name END AS sector FROM d WHERE kind < 2 AND name IN (SELECT p_brand FROM part WHERE p_partkey % 7 > 3) OR kind IN (2, 3) AND name IN (SELECT p_brand FROM part WHERE p_partkey < 3)"""


def _master(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A dump made of the parts, and the universe of equities: some brands, and one that no dump has."""
    p = table(spark, sf, "part")
    k, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 5
    symbol = F.concat(F.lit("N"), k, F.when(kind < 2, "-EQ").otherwise(""))
    line = F.to_json(F.struct(k.alias("token"), symbol.alias("symbol"), F.col("p_brand").alias("name"), F.when(kind == 2, "29JAN2026").otherwise("").alias("expiry"), F.when(kind == 2, (F.floor("p_retailprice") * 100).cast("string")).otherwise("0").alias("strike"), F.when(kind == 0, "0").otherwise("25").alias("lotsize"), F.lit("5").alias("tick_size"),
                              F.when(kind == 2, "OPTIDX").when(kind == 3, "AMXIDX").when(kind == 4, "FUTIDX").otherwise("").alias("instrumenttype"), F.when(kind == 2, "NFO").otherwise("NSE").alias("exch_seg"), F.lit("1").alias("freeze_qty")))
    listed = p.where("p_partkey % 7 > 3").select(F.col("p_brand").alias("name")).distinct().withColumn("sector", F.concat(F.lit("sector of "), "name"))
    listed = listed.union(spark.createDataFrame([("NONE", "no sector")], "name string, sector string"))
    indices = [r.p_brand for r in p.where("p_partkey < 3").select("p_brand").distinct().collect()]  # at most three names: the universe's setting
    return files.instrument_master(p.select(line.alias("value")), indices, ["NFO", "BFO"], listed), listed


@query(_MASTER)
def instrument_rows(spark, sf) -> DataFrame:
    """Indices, their options and the listed equities out of a broker's dump."""
    return _master(spark, sf)[0]


@query(f"SELECT 'NONE' AS name UNION ALL SELECT DISTINCT p_brand FROM part WHERE p_partkey % 7 > 3 AND p_brand NOT IN (SELECT name FROM ({_MASTER}) WHERE kind = 'EQ')")
def unresolved_equities(spark, sf) -> DataFrame:
    """Listed equities that the dump does not have."""
    rows, listed = _master(spark, sf)
    return files.unresolved(listed, rows).select("name")


@query("SELECT o_custkey AS account, count(*) AS n FROM orders WHERE o_custkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY ALL")
def unresolved_accounts(spark, sf) -> DataFrame:
    """Orders of a universe (every fourth account) whose account is not among those in good standing: what a report of unresolved names lists."""
    good = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("account"))
    wanted = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("account"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("account")).join(wanted, "account", "left_semi")
    return o.join(good, "account", "left_anti").groupBy("account").agg(F.count(F.lit(1)).alias("n"))
