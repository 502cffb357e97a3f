"""Column expressions for cleaning, keys, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of a request id, SYMBOL_Qquarter_year.
CUSTOM_ID = r"^(.*)_Q(\d+)_(\d+)$"
TRUNCATION_MARKER = "\n\n[... middle section truncated ...]\n\n"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate_middle(text: Column, limit: int = 80000, head: int = 30000, tail: int = 50000) -> Column:
    """Keep the head and the tail of a text longer than ``limit`` characters."""
    short = F.concat(F.left(text, F.lit(head)), F.lit(TRUNCATION_MARKER), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, short).otherwise(text)


def custom_id(symbol: Column, quarter: Column, year: Column) -> Column:
    return F.concat(symbol, F.lit("_Q"), quarter.cast("string"), F.lit("_"), year.cast("string"))


def custom_id_parts(cid: Column) -> list[Column]:
    """symbol, quarter, year of a request id; all NULL when it is malformed."""
    good = cid.rlike(CUSTOM_ID)
    part = [F.when(good, F.regexp_extract(cid, CUSTOM_ID, i)) for i in (1, 2, 3)]
    return [part[0].alias("symbol"), part[1].cast("int").alias("quarter"), part[2].cast("int").alias("year")]


def unfenced(text: Column) -> Column:
    """Response text without surrounding whitespace and code fences."""
    body = stripped(text)
    body = F.when(body.startswith("```"), F.regexp_replace(body, r"^```[^\n]*\n", "")).otherwise(body)
    body = F.when(body.endswith("```"), F.regexp_replace(body, r"```$", "")).otherwise(body)
    return stripped(body)


def parsed_date(text: Column) -> Column:
    """Date of a text that starts with an ISO date; NULL when it does not parse."""
    return F.left(text, F.lit(10)).try_cast("date")


def fallback_event_date(text: Column, quarter: Column, year: Column) -> Column:
    """First ten characters of the date text, else mid-month after the quarter ended."""
    month = F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10), F.lit(1)), quarter)
    guess = F.make_date(F.when(quarter == 4, year + 1).otherwise(year), month, F.lit(15))
    return F.coalesce(F.when(F.length(text) > 0, F.left(text, F.lit(10))), guess.cast("string"))


def reconstructed_date(quarter: Column, year: Column) -> Column:
    return F.make_date(year, quarter * 3, F.lit(15))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def recommendation(signal: Column, confidence: Column) -> Column:
    """Display text of a signal; the wording is fixed."""
    return (
        F.when((signal == "LONG") & (confidence == "high"), "Strong Buy — model expects significant outperformance")
        .when(signal == "LONG", "Buy — model expects moderate outperformance")
        .when((signal == "SHORT") & (confidence == "high"), "Strong Sell — model expects significant underperformance")
        .when(signal == "SHORT", "Sell — model expects moderate underperformance")
        .otherwise("Hold — no clear signal")
    )
