"""Pack sizes in supplier texts: two grammars as cascades of regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# Unit spellings and what they are written as.
UNITS = {
    "fl oz": "FL OZ", "floz": "FL OZ", "fl_oz": "FL OZ", "oz": "OZ",
    "gal": "GAL", "gallon": "GAL", "gallons": "GAL",
    "qt": "QT", "quart": "QT", "quarts": "QT",
    "pt": "PT", "pint": "PT", "pints": "PT",
    "ml": "ML", "l": "L", "liter": "L", "litre": "L", "liters": "L", "litres": "L",
    "lb": "LB", "lbs": "LB", "pound": "LB", "pounds": "LB",
    "g": "G", "gram": "G", "grams": "G", "kg": "KG", "kilogram": "KG", "kilograms": "KG",
    "ct": "CT", "count": "CT", "ea": "EA", "each": "EA", "pc": "CT", "pcs": "CT",
    "pk": "PK", "pack": "PK", "packs": "PK", "cs": "CS", "case": "CS",
}
UNIT = r"(fl\s*oz|fl_oz|gallons?|quarts?|pints?|liters?|litres?|lbs?|pounds?|grams?|kilograms?|kg|ml|oz|gal|qt|pt|l|ct|count|ea|each|pcs?|packs?|pk|cs|case)"
NUM = r"(\d+(?:\.\d+)?)"
#: In compatible mode a unit starts at a word boundary, so that a number and a unit written together don't match.
GLUED, APART = UNIT + r"\b", r"\b" + UNIT + r"\b"


def patterns(strict_compat: bool = False) -> dict[str, str]:
    u = APART if strict_compat else GLUED
    return {
        "eacs_split": rf"(?i){NUM}\s*{u}\s*(?:ea|each)?\s*[,;]?\s*(\d+)\s*/\s*(?:cs|case)\b",
        "compact_slash": rf"(?i)(\d+)\s*[/\\]\s*{NUM}\s*{u}",
        "count_only_slash": r"(?i)(\d+)\s*[/\\]\s*(ea|each|cs|case|ct|count|pk|pack)\b",
        "reversed_slash": rf"(?i){NUM}\s*{u}\s*[/\\]\s*(\d+)\s*(?:pk|pack|cs|case|ct)?\b",
        "cross_multiply": rf"(?i)(\d+)\s*[x×*]\s*{NUM}\s*(?:{u})?",
        "dash_separator": rf"(?i)(\d+)-{NUM}{u}",
        "case_of": r"(?i)case\s+(?:of|pack:?)\s+(\d+)",
        "per_case": r"(?i)(\d+)\s+per\s+case",
        "plain_size": rf"(?i){NUM}\s*{u}",
    }


#: Groups of (case, quantity, unit) in each pattern, 0: none; and the confidence.
_LAYERS = {
    "eacs_split": (3, 1, 2, "high"), "compact_slash": (1, 2, 3, "high"), "count_only_slash": (1, 0, 2, "medium"), "reversed_slash": (3, 1, 2, "high"), "cross_multiply": (1, 2, 3, ""),
    "dash_separator": (1, 2, 3, "high"), "case_of": (1, 0, 0, "medium"), "per_case": (1, 0, 0, "medium"), "plain_size": (0, 1, 2, "low"),
}


def unit(raw: Column, units: dict[str, str] = UNITS) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k.replace("_", " "), v)])
    return F.coalesce(table[F.translate(F.lower(F.trim(raw)), "-_", "  ")], F.upper(raw))


def quantity(q: Column) -> Column:
    """Without zeros after the point and before the number where it is whole."""
    whole = F.regexp_replace(F.regexp_replace(q, r"\.0+$", ""), r"^0+(?=\d)", "")
    return F.when(q.rlike(r"^\d+(\.0+)?$"), whole).otherwise(q)


def parse_pack(c: Column, strict_compat: bool = False) -> Column:
    """A pack text as a struct of raw_pack_text, case_pack, pack_size, unit_measure, pack_confidence and pack_method; null if no layer matches.

    The layers stand in one function of an array's element: they'd make generated code too large to compile well.
    """
    return F.get(F.transform(F.array(F.trim(c)), lambda t: _layers(t, strict_compat)), 0)


def _layers(t: Column, strict_compat: bool) -> Column:
    out = None
    for method, pattern in patterns(strict_compat).items():
        case, qty, un, sure = _LAYERS[method]
        get = lambda k, p=pattern: F.regexp_extract(t, p, k) if k else F.lit("")
        measure = F.when(get(un) != "", unit(get(un))).otherwise("") if un else F.lit("")
        size = F.trim(F.concat_ws(" ", quantity(get(qty)), F.nullif(measure, F.lit("")))) if qty else F.lit("")
        confidence = F.lit(sure) if sure else F.when(get(un) != "", "high").otherwise("medium")
        found = F.struct(t.alias("raw_pack_text"), get(case).alias("case_pack"), size.alias("pack_size"), measure.alias("unit_measure"), confidence.alias("pack_confidence"), F.lit(method).alias("pack_method"))
        out = F.when(t.rlike(pattern), found) if out is None else out.when(t.rlike(pattern), found)
    return out


def parse_pack_title(c: Column, strict_compat: bool = False) -> Column:
    """The first part of a title that is a pack text; its confidence is medium at most."""
    parts = F.filter(F.transform(F.split(c, r"[,|;–—]|--|\s{2,}"), F.trim), lambda x: x != "")
    hits = F.filter(F.transform(parts, lambda x: _layers(x, strict_compat)), lambda s: s.isNotNull())
    lower = lambda s: s.withField("pack_confidence", F.when(s["pack_confidence"] == "high", "medium").otherwise(s["pack_confidence"])).withField("pack_method", F.concat(F.lit("title:"), s["pack_method"]))
    return F.get(F.transform(F.slice(hits, 1, 1), lower), 0)


def enrich_pack(df, strict_compat: bool = False):
    """Pack columns from pack_size, else case_pack, else both together, else the title."""
    size, case, name = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("pack_size", "case_pack", "product_name"))
    both = F.concat_ws(" ", F.nullif(case, F.lit("")), F.nullif(size, F.lit("")))
    texts = F.filter(F.array(size, case, both), lambda x: x != "")
    hits = F.filter(F.transform(texts, lambda x: _layers(x, strict_compat)), lambda s: s.isNotNull())
    df = df.withColumn("_pack", F.coalesce(F.get(hits, 0), F.when(name != "", parse_pack_title(name, strict_compat))))
    keep = lambda c: F.coalesce(F.nullif(F.col(f"_pack.{c}"), F.lit("")), F.col(c))
    out = {c: F.coalesce(F.col(f"_pack.{c}"), F.lit("")) for c in ("raw_pack_text", "unit_measure", "pack_confidence")}
    return df.withColumns(out | {"pack_size": keep("pack_size"), "case_pack": keep("case_pack")}).drop("_pack")


# Units of abbreviations in titles.
TITLE_UNITS = {"fl oz": "FL OZ", "fl. oz": "FL OZ", "floz": "FL OZ", "fl.oz": "FL OZ", "oz": "OZ", "ct": "CT", "cnt": "CT", "count": "CT", "lb": "LB", "lbs": "LB", "gal": "GAL", "gl": "GAL", "ml": "ML", "l": "L", "g": "G", "kg": "KG", "pk": "PK", "pack": "PK"}
TITLE_UNIT = r"(fl\.?\s*oz|floz|oz|ct|cnt|count|lbs?\.?|gal|gl|ml|kg|l(?=\s|/|\d|$)|g(?=\s|/|\d|$))"
SIZE_AND_PACK, PACK_ONLY, SIZE_ONLY = rf"(?i)({NUM}\s*{TITLE_UNIT}\s*/\s*(\d+)\s*(?:pk|pack)\b)", r"(?i)(?<!/)(?<!\d)((\d+)\s*(?:pk|pack)\b)", rf"(?i)({NUM}\s*{TITLE_UNIT})"


def parse_title_abbreviation(c: Column) -> Column:
    """unit_size, case_pack, raw_pack_text and a numeric confidence from 16oz/3pk, 4pk or 16oz; null if none is there."""
    table = F.create_map(*[F.lit(x) for k, v in TITLE_UNITS.items() for x in (k, v)])
    get = lambda p, k: F.regexp_extract(c, p, k)
    size = lambda p: F.concat(get(p, 2), F.lit(" "), F.coalesce(table[F.regexp_replace(squeeze(F.lower(get(p, 3))), r"\.$", "")], F.upper(F.trim(get(p, 3)))))
    row = lambda unit_size, case, raw, sure: F.struct(unit_size.alias("unit_size"), case.alias("case_pack"), raw.alias("raw_pack_text"), sure.alias("pack_confidence_score"))
    return (
        F.when(c.rlike(SIZE_AND_PACK), row(size(SIZE_AND_PACK), get(SIZE_AND_PACK, 4), get(SIZE_AND_PACK, 1), F.lit(0.95)))
        .when(c.rlike(PACK_ONLY), row(F.when(c.rlike(SIZE_ONLY), size(SIZE_ONLY)).otherwise(""), get(PACK_ONLY, 2), get(PACK_ONLY, 1), F.when(c.rlike(SIZE_ONLY), 0.80).otherwise(0.75)))
        .when(c.rlike(SIZE_ONLY), row(size(SIZE_ONLY), F.lit(""), get(SIZE_ONLY, 1), F.lit(0.60)))
    )
