"""Files of exchanges and feeds as DataFrames: delimited bars, feeds in XML and JSON, binary ticks, report sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import canonical_symbol, number

# The columns of the exchange's daily file, in order.
DAILY_COLUMNS = ("symbol", "series", "date", "prev_close", "open", "high", "low", "last", "close", "avg_price", "volume", "turnover", "trades", "delivered", "delivered_pct")


def daily_file(lines: DataFrame) -> DataFrame:
    """Rows of the exchange's daily file from lines of text (column ``value``): padded fields, ``-`` for none, dates as 05-Jan-2024.

    Every line comes back with ``reason``: null for a good row, else why it is left out (short, series, date, price, delivered).
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), ",")
    rows = lines.where(~F.upper(F.trim("value")).startswith("SYMBOL") & (F.trim("value") != "")).withColumn("_f", F.transform(f, lambda x: F.nullif(F.trim(x), F.lit("-"))))
    c = {n: F.get("_f", F.lit(i)) for i, n in enumerate(DAILY_COLUMNS)}
    num = {n: number(c[n]) for n in DAILY_COLUMNS[3:]}
    out = rows.select(canonical_symbol(c["symbol"]).alias("symbol"), c["series"].alias("series"), F.try_to_date(F.initcap(c["date"]), "dd-MMM-yyyy").alias("trade_date"), *(x.alias(n) for n, x in num.items()), F.size("_f").alias("_n"))
    bad = (
        F.when(F.col("_n") < len(DAILY_COLUMNS), "short").when(F.coalesce(F.col("series"), F.lit("")) != "EQ", "series").when(F.col("trade_date").isNull(), "date")
        .when(~F.coalesce((F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.col("low")), F.lit(False)), "price")
        .when(F.col("delivered_pct").isNotNull() & ~F.col("delivered_pct").between(0, 100), "delivered")
    )
    return out.withColumn("reason", bad).withColumn("prev_close", F.coalesce("prev_close", "close")).withColumn("volume", F.coalesce("volume", F.lit(0.0))).drop("_n")


def clean_markup(s: Column) -> Column:
    """Text of an XML field: CDATA unwrapped, tags off, common references decoded, white space to one space."""
    s = F.regexp_replace(s, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def feed_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """title, link, published of each item or entry of RSS and Atom payloads; other columns are kept. An item without title or link is left out."""
    item = F.explode(F.regexp_extract_all(F.col(payload), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1))
    x = payloads.withColumn("_i", item)

    def tag(name: str) -> Column:
        return F.regexp_extract("_i", rf"(?s)<(?:{name})\b[^>]*>(.*?)</(?:{name})>", 1)

    href = F.regexp_extract("_i", r"<link\b(?=[^>]*rel=[\"']alternate[\"'])[^>]*href=[\"']([^\"']+)", 1)
    any_href = F.regexp_extract("_i", r"<link\b[^>]*href=[\"']([^\"']+)", 1)
    first = lambda *cs: F.coalesce(*(F.nullif(clean_markup(c), F.lit("")) for c in cs))
    out = x.select(*[c for c in payloads.columns if c != payload], first(tag("title")).alias("title"), first(tag("link"), href, any_href, tag("guid|id")).alias("link"), first(tag("pubDate|published|updated")).alias("published"))
    return out.where("title IS NOT NULL AND link IS NOT NULL")


# Names that a field of an announcement goes by, the first one that is filled counts.
ANNOUNCEMENT_FIELDS = {"headline": ("HEADLINE", "NEWSSUB", "NEWS_SUB"), "file": ("ATTACHMENTNAME",), "at": ("NEWS_DT", "DissemDT", "News_submission_dt", "DT_TM"), "company": ("SLONGNAME",), "detail": ("MORE", "NEWSSUB"), "scrip": ("SCRIP_CD",)}
ATTACHMENTS = "https://www.bseindia.com/xml-data/corpfiling/AttachLive/"


def announcements(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """scrip, title, body, url, published of exchange announcements; other columns are kept.

    A payload is JSON (an object with ``Table``, or an array of rows), XML with ``<Table>`` rows, or else a feed, whose items have neither
    scrip nor body. The sentence for "none", broken JSON and rows without a headline give nothing; a stamp that is no date gives null.
    """
    others = [c for c in payloads.columns if c != payload]
    head = F.substring(F.ltrim(F.regexp_replace(payload, r"^\s+", "")), 1, 1)
    v = F.try_parse_json(payload)
    in_json = F.when(head == "{", F.try_variant_get(v, "$.Table", "array<variant>")).when(head == "[", F.try_variant_get(v, "$", "array<variant>"))
    in_xml = F.regexp_extract_all(F.col(payload), F.lit(r"(?is)<Table(?:\s[^>]*)?>(.*?)</Table>"), 1)
    x = payloads.select(*others, F.col(payload).alias("_p"), F.coalesce(head.isin("{", "[", '"'), F.lit(False)).alias("_json"), in_json.alias("_rows"), in_xml.alias("_blocks"))

    def filled(names: tuple[str, ...], get) -> Column:
        return F.coalesce(*(F.when(F.trim(get(n)) != "", get(n)) for n in names), F.lit(""))

    def fields(get) -> Column:
        return F.struct(*(filled(names, get).alias(k) for k, names in ANNOUNCEMENT_FIELDS.items()))

    # Numbers are no texts, but they are codes.
    string = lambda row, n: F.when((F.schema_of_variant(F.try_variant_get(row, f"$.{n}", "variant")) == "STRING") | F.lit(n in ANNOUNCEMENT_FIELDS["scrip"]), F.try_variant_get(row, f"$.{n}", "string"))
    of_json = F.transform("_rows", lambda row: fields(lambda n: string(row, n)))
    of_xml = F.transform("_blocks", lambda b: fields(lambda n: F.regexp_extract(b, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)))
    rows = x.select(*others, F.explode(F.when(F.col("_json"), of_json).otherwise(of_xml)).alias("r"))
    text = lambda k: F.nullif(clean_markup(F.col(f"r.{k}")), F.lit(""))
    rows = rows.select(
        *others, text("scrip").alias("scrip"), text("headline").alias("title"), F.nullif(F.concat_ws(" — ", text("company"), text("detail")), F.lit("")).alias("body"),
        F.coalesce(F.concat(F.lit(ATTACHMENTS), text("file")), F.lit("")).alias("url"), F.try_to_timestamp(text("at")).alias("published"),
    ).where("title IS NOT NULL")
    feeds = feed_items(x.where(~F.col("_json") & (F.size("_blocks") == 0)).select(*others, F.col("_p").alias(payload)), payload)
    feeds = feeds.select(*others, F.lit(None).cast("string").alias("scrip"), "title", F.lit(None).cast("string").alias("body"), F.col("link").alias("url"), F.try_to_timestamp("published").alias("published"))
    return rows.unionByName(feeds)


def _stamp(s: Column) -> Column:
    """20240105T101500Z as a time; null if it is not written so, names no day of the calendar, or leaves its day."""
    m = F.trim(s)
    part = lambda at: F.substring(m, at, 2).try_cast("int")
    seconds = part(10) * 3600 + part(12) * 60 + part(14)
    day = F.try_to_timestamp(F.substring(m, 1, 8), F.lit("yyyyMMdd"))
    return F.when(m.rlike(r"^[0-9]{8}T[0-9]{6}Z$") & (seconds < 86400), F.timestamp_add("SECOND", seconds, day))


def _articles(payload: Column) -> tuple[Column, Column]:
    """The payload as a variant (null: no JSON), and its list of articles as variants."""
    v = F.try_parse_json(payload)
    return v, F.try_variant_get(v, "$.articles", "array<variant>")


def archive_windows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``payloads`` with status instead of the payload: failed (it is no JSON: an error page, a notice), empty (JSON without articles) or ok, and how many articles were listed."""
    v, listed = _articles(F.col(payload))
    n = F.coalesce(F.size(listed), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return payloads.withColumn("status", F.when(v.isNull(), "failed").when(n == 0, "empty").otherwise("ok")).withColumn("articles", n).drop(payload)


def archive_articles(payloads: DataFrame, payload: str = "payload", latency_minutes: int = 0) -> DataFrame:
    """url, title, domain, published, available_at of the articles of archive windows; other columns are kept.

    An article needs an address, a title and a stamp that are strings and say something; the domain is empty if it is no string.
    ``available_at``, what research may go by, is the stamp and ``latency_minutes``.
    """
    others = [c for c in payloads.columns if c != payload]
    x = payloads.select(*others, F.explode(_articles(F.col(payload))[1]).alias("_a"))

    def text(name: str) -> Column:
        it = F.try_variant_get("_a", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(it) == "STRING", F.try_variant_get("_a", f"$.{name}", "string"))

    title = F.trim(F.regexp_replace(F.regexp_replace(clean_markup(text("title")), r"\s+([,.:;!?%])", "$1"), r"\s+", " "))
    x = x.select(*others, F.regexp_replace(text("url"), r"^\s+|\s+$", "").alias("url"), title.alias("title"), F.coalesce(text("domain"), F.lit("")).alias("domain"), _stamp(text("seendate")).alias("published"))
    return x.where("url <> '' AND title <> '' AND published IS NOT NULL").withColumn("available_at", F.timestamp_add("MINUTE", F.lit(latency_minutes), F.col("published")))


def archive_records(lines: DataFrame) -> DataFrame:
    """Media-archive records from JSON lines: url, domain, title, seen; a stamp that is no date gives null, a broken line no row."""
    x = lines.select(F.from_json("value", "date string, url string, domain string, title string").alias("j")).where("j.url IS NOT NULL").select("j.*")
    return x.select("url", F.lower("domain").alias("domain"), F.trim(F.regexp_replace("title", r"\s+([,.;:!?])", "$1")).alias("title"), F.try_to_timestamp("date", F.lit("yyyyMMdd'T'HHmmssX")).alias("seen"))


def first_seen(records: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """Records whose ``keys`` (url, or source and url) are not known yet, each once, the earliest."""
    one = records.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in records.columns if c not in keys]), F.struct(F.coalesce(F.col("seen"), F.lit("9999-12-31").cast("timestamp")), "title")).alias("r"))
    return one.select(*keys, "r.*").join(known.select(*keys), list(keys), "left_anti")


MASTER = "token string, symbol string, name string, expiry string, strike string, lotsize string, tick_size string, instrumenttype string, exch_seg string, freeze_qty string"


def instrument_master(lines: DataFrame, indices: list[str], segments: list[str], equities: DataFrame) -> DataFrame:
    """Instruments of the universe from a broker's dump (a JSON object a line): indices and their options, and the equities (name, sector).

    Strikes are in hundredths; so are the ticks of equities only. An option's day of expiry is written 29JAN2026. What is not a number is null,
    but for an equity's lot, which is 1.
    """
    x = lines.select(F.from_json("value", MASTER).alias("j")).where("j.symbol IS NOT NULL").select("j.*")
    kind, num = F.coalesce("instrumenttype", F.lit("")), lambda c: F.col(c).try_cast("double")
    index = F.col("name").isin(indices) & ((kind == "AMXIDX") | ((kind == "OPTIDX") & F.col("exch_seg").isin(segments)))
    equity = (F.col("exch_seg") == "NSE") & (kind == "") & F.col("symbol").endswith("-EQ")
    x = x.join(equities.select("name", "sector", F.lit(True).alias("_listed")), "name", "left").withColumn("_eq", equity & F.coalesce("_listed", F.lit(False))).where(index | F.col("_eq"))
    eq = F.col("_eq")
    return x.select(
        F.concat_ws(":", "exch_seg", "symbol").alias("id"), "token", "symbol", "name", F.when(~eq, F.try_to_date(F.initcap("expiry"), "ddMMMyyyy")).alias("expiry"), F.when(eq, 0.0).otherwise(num("strike") / 100).alias("strike"),
        F.when(eq, F.coalesce(F.nullif(num("lotsize"), F.lit(0.0)), F.lit(1.0))).otherwise(num("lotsize")).alias("lot"), F.when(eq, num("tick_size") / 100).otherwise(num("tick_size")).alias("tick"),
        F.when(eq, "EQ").otherwise(kind).alias("kind"), F.when(eq, F.col("sector")).alias("sector"),
    )


def unresolved(equities: DataFrame, master: DataFrame) -> DataFrame:
    """Equities of the universe that the dump does not have: renamed or no longer listed."""
    return equities.join(master.where("kind = 'EQ'").select("name"), "name", "left_anti")


TICK = "instrument_token string, ltp double, volume long, bid double, ask double"


def _number(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: int, kind: str) -> np.ndarray:
    """The little-endian number at ``at`` of each frame; 0 where the frame ends before it."""
    width = np.dtype(kind).itemsize
    there = size >= at + width
    where = np.where(there, start + at, 0)[:, None] + np.arange(width)
    return np.where(there, np.ascontiguousarray(data[where]).view(kind)[:, 0], 0)


def ticks(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Binary little-endian ticks: token at 2..27, price / 100 at 43, volume at 67, best five of two sides from 147 in steps of 20 (side, quantity, price).

    A side's price is its first level with a quantity and a price, in the order of the frame; a side without one falls back to the price.
    Frames under 51 bytes and null ones give nothing. The fields of a batch's frames are read together, column by column.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = [bytes(x) for x in pdf[frame] if x is not None and len(x) >= 51]
            size = np.array([len(x) for x in raw], np.int64)
            start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(raw) else size
            data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
            ltp = _number(data, start, size, 43, "<i8") / 100
            best = {0: ltp.copy(), 1: ltp.copy()}
            open_ = {0: np.ones(len(raw), bool), 1: np.ones(len(raw), bool)}
            for k in range(10):
                at = 147 + 20 * k
                side, quantity, price = (_number(data, start, size, at + d, t) for d, t in ((0, "<i2"), (2, "<i8"), (10, "<i8")))
                fits = (size >= at + 20) & (quantity > 0) & (price > 0)
                for s in (0, 1):
                    hit = fits & (side == s) & open_[s]
                    best[s][hit] = price[hit] / 100
                    open_[s] &= ~hit
            token = [x[2:27].split(b"\0")[0].decode("ascii", "replace").strip() for x in raw]
            yield pd.DataFrame({"instrument_token": pd.Series(token, dtype=object), "ltp": ltp, "volume": _number(data, start, size, 67, "<i8"), "bid": best[1], "ask": best[0]})

    return frames.select(frame).mapInPandas(run, TICK)


def cohort(snapshots: DataFrame, first: str) -> DataFrame:
    """symbol, sector, exit_label of those in the snapshot ``first``: latest sector, and the first snapshot without them (null if they are in all). snapshots: label, symbol, sector."""
    labels = snapshots.select("label").distinct().agg(F.sort_array(F.collect_set("label")).alias("all"))  # a row; labels are few
    g = snapshots.groupBy("symbol").agg(F.max_by("sector", "label").alias("sector"), F.collect_set("label").alias("own")).where(F.array_contains("own", first))
    later = F.filter("all", lambda x: (x > first) & ~F.array_contains(F.col("own"), x))
    return g.crossJoin(labels).select("symbol", "sector", F.get(later, F.lit(0)).alias("exit_label"))


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A report of few rows as one CSV with minimal quoting; numbers that are not finite are left empty."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    df.select(*(finite(c).alias(c) if c in doubles else c for c in df.columns)).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of one run, once: a run that is written again replaces its own partition only."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


