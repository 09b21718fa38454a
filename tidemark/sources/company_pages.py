"""Tables of a company's page as columns: the quarterly table in long form, headline ratios, the exchange's code. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the quarterly table that are read, by the beginning of their label.
ROWS = {"eps": "EPS in Rs", "net_profit": "Net Profit", "sales": "Sales"}


def month_end(label: Column) -> Column:
    """The last day of "Jun 2026" or "June 2026"; null for anything else."""
    text = F.trim(label)
    parts = F.concat_ws(" ", F.lit("01"), F.initcap(F.substring(text, 1, 3)), F.right(text, F.lit(4)))
    return F.when(text.rlike(r"^[A-Za-z]{3}[a-z]*\s+[0-9]{4}$"), F.last_day(F.try_to_timestamp(parts, F.lit("dd MMM yyyy")).cast("date")))


def plain(cell: Column) -> Column:
    """Text of a cell: tags and white space become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", " "), "&nbsp;", " "), r"\s+", " "))


def number(text: Column) -> Column:
    """"1,23,456.78" and "-3.5" as numbers; null for an empty cell, a dash and what is no number."""
    x = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))


def section(page: Column, name: str = "quarters") -> Column:
    """The part of a page from the id to the end of its section, or of the page; null without it."""
    at = F.instr(page, F.lit(f'id="{name}"'))
    rest = F.substring(page, at, F.length(page))
    end = F.instr(rest, F.lit("</section>"))
    return F.when(at > 0, F.when(end > 0, F.substring(rest, F.lit(1), end + 9)).otherwise(rest))


def row_values(table: Column, label: str) -> Column:
    """Numbers of the first row whose label begins so (null: none); what follows a row's last cell counts as an empty one."""
    pieces = F.split(table, "</tr>")
    rows = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(F.regexp_extract(p, '(?s)<tr[^>]*>\\s*<td class="text">.*', 0), "</td>"))
    named = F.filter(rows, lambda c: F.lower(plain(c[0])).startswith(label.lower()))
    return F.transform(F.slice(F.get(named, F.lit(0)), F.lit(2), F.greatest(F.size(F.get(named, F.lit(0))) - 1, F.lit(0))), lambda c: number(plain(c)))


def quarters(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """key, period_end, eps, net_profit, sales: a row a quarter that has an EPS.

    Columns are named by the table's month headers, and a row's cells are counted from its end: of more cells than headers the last
    ones count. Pages without the table, or null, give no row; other columns are not read.
    """
    t = pages.select(F.col(key), section(F.col(page)).alias("_t")).where("_t IS NOT NULL")
    heads = F.regexp_extract_all("_t", F.lit(r"<th[^>]*>\s*([A-Za-z]{3}\s+[0-9]{4})\s*</th>"), F.lit(1))
    t = t.select(key, heads.alias("_h"), *(row_values(F.col("_t"), label).alias(k) for k, label in ROWS.items())).where("size(_h) > 0 AND eps IS NOT NULL")
    tail = lambda k: F.slice(k, F.greatest(F.size(k) - F.size("_h") + 1, F.lit(1)), F.greatest(F.size("_h"), F.lit(1)))
    t = t.select(key, F.posexplode("_h").alias("_i", "_label"), *(F.when(F.col(k).isNotNull(), tail(k)).alias(k) for k in ROWS))
    t = t.select(key, month_end(F.col("_label")).alias("period_end"), *(F.get(k, F.col("_i")).alias(k) for k in ROWS))
    return t.where("period_end IS NOT NULL AND eps IS NOT NULL")


def ratios(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """key, place, name, value of the headline ratios: the first number of each item that has one."""
    items = F.filter(F.transform(F.split(page, "</li>"), lambda p: F.regexp_extract(p, '(?s)<li[^>]*>\\s*<span class="name">.*', 0)), lambda p: p != "")
    x = pages.select(F.col(key), F.posexplode(items).alias("place", "_item"))
    numbers = F.filter(F.transform(F.regexp_extract_all("_item", F.lit(r'<span class="number">\s*([0-9.,\-]*)\s*</span>'), F.lit(1)), number), lambda v: v.isNotNull())
    return x.select(key, "place", F.trim(F.regexp_replace(F.regexp_extract("_item", r'<span class="name">([^<]+)</span>', 1), r"^\s+|\s+$", "")).alias("name"), F.get(numbers, F.lit(0)).alias("value")).where("value IS NOT NULL AND name <> ''")


def exchange_code(page: Column) -> Column:
    """Six digits of the link to the exchange's page; null without one."""
    return F.nullif(F.regexp_extract(page, "bseindia\\.com/stock-share-price/[^\"']*?/([0-9]{6})/", 1), F.lit(""))
