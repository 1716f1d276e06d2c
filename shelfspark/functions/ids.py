"""Barcodes and other identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import present
from .text import squeeze

# Where a barcode may stand, first to last.
BARCODE_FIELDS = ["upc", "ean", "gtin", "gtin_case", "barcode", "barcode_raw"]


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")


def barcode(c: Column) -> Column:
    """8 to 14 digits, else ''."""
    d = digits(c)
    return F.when(F.length(d).between(8, 14), d).otherwise("")


def barcode_or_raw(c: Column) -> Column:
    d = digits(squeeze(c))
    return F.when(F.length(d).between(8, 14), d).otherwise(squeeze(c))


def barcode_kind(d: Column) -> Column:
    n = F.length(d)
    return F.when(n == 0, "").when(n == 8, "ean8").when(n == 12, "upc").when(n == 13, "ean13").when(n == 14, "gtin14").otherwise("barcode")


def check_digit(body: Column) -> Column:
    """The GS1 check digit of a string of digits: weights 3 and 1 in turn from the right."""
    # digits are taken by position, so the expression needs neither a join nor an explode
    n = F.length(body)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    weighed = F.transform(at, lambda i: F.coalesce(F.substring(body, i, 1).try_cast("int"), F.lit(0)) * F.when((n - i) % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10) % 10


def has_valid_check_digit(c: Column) -> Column:
    """A GTIN of 8, 12, 13 or 14 digits, of more than two different ones, whose last is the check digit."""
    d = digits(c)
    n = F.length(d)
    different = F.size(F.array_distinct(F.filter(F.split(d, ""), lambda x: x != "")))
    return n.isin(8, 12, 13, 14) & (different > 2) & (check_digit(F.substring(d, F.lit(1), n - 1)) == F.right(d, F.lit(1)).try_cast("int"))


def first_valid(*texts: Column) -> Column:
    """The first run of digits, spaces and hyphens in the texts that is a valid GTIN, else ''."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(t.cast("string"), F.lit("")), F.lit(r"(\b\d[\d\s-]{6,20}\d\b)"), F.lit(1)) for t in texts)))
    return F.coalesce(F.get(F.filter(F.transform(found, digits), has_valid_check_digit), 0), F.lit(""))


def upc12(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 12, d).when((F.length(d) == 14) & d.startswith("00"), F.substring(d, 3, 12)).otherwise("")


def labelled_upc(text: Column) -> Column:
    """A UPC that a label announces within thirty characters."""
    found = lambda label: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b{label}\b[^0-9]{{0,30}}(\d{{12,14}})"), F.lit(1))
    every = F.flatten(F.array(found("(?:upc|barcode)"), found("gtin"), found("(?:item id|model number)")))
    return F.coalesce(F.get(F.filter(F.transform(every, upc12), lambda x: x != ""), 0), F.lit(""))


def labelled_identifier(text: Column) -> Column:
    """The first labelled identifier of 8 to 14 digits."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:upc|ean|gtin|barcode)\b\s*(?:#|number|code)?\s*[:\-]?\s*([0-9][0-9\-\s]{7,24})"), F.lit(1))
    return F.coalesce(F.get(F.filter(F.transform(every, barcode), lambda x: x != ""), 0), F.lit(""))


def normalize_products(df: DataFrame) -> DataFrame:
    """Single spaces in all text; the first barcode fills barcode_raw and identifier_type, and upc, ean or gtin where empty."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    df = df.withColumns({c: squeeze(F.col(c)) for c in texts})
    here = [c for c in BARCODE_FIELDS if c in texts]
    if not here:
        return df
    for c in ("upc", "ean", "gtin", "barcode_raw", "identifier_type"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    code = F.coalesce(*(present(barcode(F.col(c))) for c in here), F.lit(""))
    raw = F.coalesce(*(F.when(barcode(F.col(c)) != "", F.trim(c)) for c in here), F.lit(""))
    df = df.withColumns({"_code": code, "_raw": raw}).withColumn("_kind", barcode_kind(F.col("_code")))
    fill = lambda c, ok: F.when((F.col("_code") != "") & ok & (F.col(c) == ""), F.col("_code")).otherwise(F.col(c))
    out = {
        "barcode_raw": F.when(F.col("_code") != "", F.col("_raw")).otherwise(F.col("barcode_raw")),
        "identifier_type": F.when(F.col("_code") != "", F.col("_kind")).otherwise(F.col("identifier_type")),
        "upc": fill("upc", F.lit(True)),
        "ean": fill("ean", F.col("_kind").startswith("ean")),
        "gtin": fill("gtin", F.col("_kind").startswith("gtin")),
    }
    return df.withColumns(out).drop("_code", "_raw", "_kind")


def supplier_identity(upc: Column, gtin_case: Column) -> Column:
    """How far a supplier's own identifier can be trusted as a UPC-12, as a struct of texts."""
    u, g = digits(upc), digits(gtin_case)
    raw = F.when(u != "", u).otherwise(g)
    n = F.length(raw)
    kind = F.when(n == 0, "").when((g != "") & (raw == g), "gtin_case").when(n == 12, "upc_12").when(n == 13, "gtin_13").when(n == 14, "gtin_14").when(n == 8, "gtin_8").otherwise("unknown_numeric")
    native, padded = F.length(u) == 12, (F.length(u) == 14) & u.startswith("00")
    pick = lambda a, b, c, d: F.when(native, a).when(padded, b).when(u != "", c).otherwise(d)
    trusted = lambda x: pick(x, x, F.lit(""), F.lit(""))
    return F.struct(
        pick(u, F.substring(u, 3, 12), F.lit(""), F.lit("")).alias("upc_12"),
        raw.alias("native_identifier"),
        kind.alias("native_identifier_type"),
        raw.alias("normalized_identifier"),
        pick(F.lit("native_upc"), F.lit("converted_padded_gtin14"), F.when(kind == "", "supplier_identifier_present").otherwise(kind), F.lit("missing_identifier")).alias("identifier_status"),
        pick(F.lit("0"), F.lit("0"), F.lit("1"), F.lit("1")).alias("needs_resolution"),
        trusted(F.lit("supplier_page")).alias("resolution_source"),
        pick(F.lit("native_12_digit"), F.lit("strip_gtin14_padding"), F.lit(""), F.lit("")).alias("resolution_method"),
        trusted(F.lit("high")).alias("resolution_confidence"),
        trusted(F.lit("green")).alias("resolution_color"),
        pick(F.lit("native"), F.lit("converted"), F.lit("needs_external_resolution"), F.lit("needs_external_resolution")).alias("resolution_status"),
        raw.alias("raw_identifier"),
    )


# Marks of generated ids.
GENERATED = r"(?i)product-card|image|icon|btn-|container|wrapper|tooltip|modal"


def is_catalog_sku(c: Column, bad: str = GENERATED) -> Column:
    """A supplier's item number: 3 to 25 of letters, digits, - . /, a digit among them."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.length(s).between(3, 25) & s.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-\./]*$") & s.rlike(r"\d") & ~s.rlike(bad)


def same_sku(a: Column, b: Column) -> Column:
    """Equal or contained after folding to letters and digits."""
    fold = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)[^a-z0-9]", ""))
    x, y = fold(a), fold(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def is_detail_sku(c: Column) -> Column:
    """An item number of a detail page: 2 to 32 of letters, digits, - . / and spaces, a digit among them, no UUID."""
    s = F.trim(F.coalesce(c, F.lit("")))
    uuid = s.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.length(s).between(2, 32) & ~uuid & s.rlike(r"\d") & s.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-./ ]*$")


def detail_upc(c: Column) -> Column:
    """Without white space and hyphens 8 to 14 digits, else ''."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-]", "")
    return F.when(d.rlike(r"^\d{8,14}$"), d).otherwise("")


def identifier_fields(d: Column) -> Column:
    """upc, ean, gtin, barcode_raw and identifier_type of one identifier."""
    kind = barcode_kind(d)
    return F.struct(d.alias("upc"), F.when(kind.startswith("ean"), d).otherwise("").alias("ean"), F.when(kind == "gtin14", d).otherwise("").alias("gtin"), d.alias("barcode_raw"), kind.alias("identifier_type"))
