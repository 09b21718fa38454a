"""Text functions: titles, symbols, hosts, dates, numbers in Indian notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that titles are compared without.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "as", "is", "are", "be", "this", "that", "it", "its", "after", "over", "amid", "up", "down", "vs", "via",
)


def canonical_symbol(s: Column) -> Column:
    """A symbol without its series suffix."""
    return F.regexp_replace(F.upper(F.trim(s)), "-(EQ|BE|BZ|SM|ST)$", "")


def by_canonical_symbol(rows: DataFrame, symbol: str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each canonical symbol, with ``canonical`` and ``collisions``: how many more rows have it. Null symbols are one."""
    x = rows.withColumn("canonical", canonical_symbol(F.col(symbol)))
    w = Window.partitionBy("canonical")
    return x.withColumn("collisions", F.count(F.lit(1)).over(w) - 1).withColumn("_k", F.row_number().over(w.orderBy(*order))).where("_k = 1").drop("_k")


def normal_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9&]+", " "), " +", " "))


def title_tokens(s: Column) -> Column:
    words = F.filter(F.split(normal_title(s), " "), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/?#:]+)", 1))


def site(url: Column) -> Column:
    """A web address without scheme, www, path, query and port, in lower case."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^https?://", ""), r"^www\.", "")
    return F.regexp_extract(s, "^[^/?:]*", 0)


def of_domains(site: Column, domains: tuple[str, ...], country: str = "in") -> Column:
    """Whether a site lies under the country's domain, or is one of ``domains`` or under one."""
    under = F.regexp_extract_all(F.concat(F.lit("."), site), F.lit(r"(?=(\.(.+)))"), 2)
    return (site == country) | site.endswith(f".{country}") | F.exists(under, lambda x: x.isin(*domains))


# Industry labels and the sector each one counts as.
SECTORS = {
    "FINANCIAL SERVICES": "Financial Services",
    "HEALTHCARE": "Healthcare",
    "HEALTHCARE SERVICES": "Healthcare",
    "PHARMA": "Healthcare",
    "AUTOMOBILE": "Auto",
    "AUTOMOBILE AND AUTO COMPONENTS": "Auto",
    "INFORMATION TECHNOLOGY": "IT",
    "IT": "IT",
    "CONSUMER GOODS": "FMCG",
    "FAST MOVING CONSUMER GOODS": "FMCG",
    "CONSUMER SERVICES": "Services",
    "SERVICES": "Services",
    "CONSUMER DURABLES": "Consumer Durables",
    "POWER": "Power",
    "ENERGY": "Power",
    "OIL GAS & CONSUMABLE FUELS": "Oil & Gas",
    "METALS": "Metals & Mining",
    "METALS & MINING": "Metals & Mining",
    "CONSTRUCTION": "Construction",
    "CONSTRUCTION MATERIALS": "Construction Materials",
    "MEDIA & ENTERTAINMENT": "Media",
    "MEDIA ENTERTAINMENT & PUBLICATION": "Media",
    "INDUSTRIAL MANUFACTURING": "Capital Goods",
    "CAPITAL GOODS": "Capital Goods",
    "CHEMICALS": "Chemicals",
    "REALTY": "Realty",
    "TEXTILES": "Textiles",
    "TELECOMMUNICATION": "Telecom",
    "TELECOM": "Telecom",
    "DIVERSIFIED": "Diversified",
}


def sector_name(label: Column) -> Column:
    """The sector of an industry label; a label that is not known stays as it is, trimmed."""
    names = F.create_map(*(F.lit(x) for kv in SECTORS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(label))), F.trim(label))


# Terms of Indian business English and what stands for them; (?i) where case does not count.
INDIA_TERMS = (
    (r"\bPAT\b", "net profit"),
    (r"\bPBT\b", "pre-tax profit"),
    (r"(?i)\bYoY\b", "year-on-year"),
    (r"(?i)\bQoQ\b", "quarter-on-quarter"),
    (r"\bMoM\b", "month-on-month"),
    (r"(?i)\bbps\b", "basis points"),
    (r"\bNPA(s)?\b", "bad loan$1"),
    (r"(?i)\bcapex\b", "capital expenditure"),
    (r"(?i)\btopline\b", "revenue"),
    (r"(?i)\bbottomline\b", "net profit"),
    (r"(?i)\bdemat\b", "brokerage"),
    (r"\bFII(s)?\b", "foreign institutional investor$1"),
    (r"\bDII(s)?\b", "domestic institutional investor$1"),
    (r"(?i)\bQ([1-4])\s*FY\s*(\d{2,4})\b", "Q$1 fiscal year $2"),
    (r"(?i)\bFY\s*(\d{2,4})\b", "fiscal year $1"),
)
# How amounts are written, and millions in each unit.
CURRENCY = r"(?i)(?:₹\s*|\bRs\.?\s+|\bINR\s+)"
AMOUNT, UNITS = r"(\d[\d,]*(?:\.\d+)?)", ((r"(?:crores?|cr)", 10.0), (r"(?:lakhs?)", 0.1))
UNIT_WORDS = ((r"(?i)\bcrores?\b", "tens of millions"), (r"(?i)\blakhs?\b", "hundreds of thousands"))


def western_units(text: Column) -> Column:
    """Indian units, currency signs and acronyms in plain English; amounts in crore and lakh become millions and billions.

    What lies between the amounts and the amounts themselves are two arrays, which are zipped again: no Python.
    """
    s = F.regexp_replace(text, CURRENCY, "INR ")
    for unit, millions in UNITS:
        p = rf"(?i){AMOUNT}\s*{unit}\b"
        m = lambda x, k=millions: F.regexp_replace(x, ",", "").cast("double") * k
        money = F.transform(F.regexp_extract_all(s, F.lit(p), 1), lambda x: F.when(F.abs(m(x)) >= 1000, F.format_string("%.2f billion", m(x) / 1000)).otherwise(F.format_string("%.2f million", m(x))))  # noqa: B023
        s = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(s, p, -1).alias("a"), money.alias("b")), lambda z: F.array(z["a"], F.coalesce(z["b"], F.lit(""))))), "")
    for p, x in (*UNIT_WORDS, *INDIA_TERMS):
        s = F.regexp_replace(s, p, x)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def matches_all(text: Column, query: str) -> Column:
    """Every run of letters or digits of ``query`` occurs in ``text``, case aside."""
    import re

    found = F.lit(True)
    for part in re.findall(r"[A-Za-z]+|[0-9]+", query):
        found = found & F.contains(F.lower(text), F.lit(part.lower()))
    return found


def number(s: Column) -> Column:
    """A number with grouping commas, a currency sign or a percent sign; null if it is none."""
    return F.regexp_replace(s, r"[,₹%\s]", "").try_cast("double")


def fallback_available(period_end: Column) -> Column:
    """When a quarter's results are public at the latest: 45 days on, 60 after the one that ends in March."""
    return F.date_add(period_end, F.when(F.month(period_end) == 3, 60).otherwise(45))
