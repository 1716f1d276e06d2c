"""The product row: a fixed order of text columns in which the empty string means missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a product row, in display order.
PRODUCT_FIELDS = [
    "product_name", "brand", "sku", "upc", "price", "pack_size", "case_pack", "image_url", "product_url",
    "upc_source", "upc_match_confidence", "upc_enriched", "missing_upc", "upc_confidence_color", "upc_match_reason",
    "raw_pack_text", "unit_measure", "pack_confidence",
    "unit_size", "unit_price", "pricing_unit",
    "bulk_price", "minimum_order_qty", "raw_price_text",
    "gtin_case", "ean", "gtin", "barcode_raw", "identifier_type",
    "category", "description", "availability",
    "source_product_id", "source_variant_id", "source_platform", "tags",
]

PRODUCT_SCHEMA = T.StructType([T.StructField(f, T.StringType(), False) for f in PRODUCT_FIELDS])


def conform(df: DataFrame, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Every product column as text, '' where missing, in order; columns in `keep` follow, others go."""
    here = set(df.columns)
    fields = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in here else F.lit("").alias(f) for f in PRODUCT_FIELDS]
    return df.select(*fields, *(c for c in keep if c in here))


def present(c: str | F.Column) -> F.Column:
    """The text, or null where it is missing; then coalesce chooses as `or` does."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("string"), F.lit(""))


def first_present(*columns: str | F.Column) -> F.Column:
    """The first column that isn't missing, else ''."""
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def missing_as_empty(df: DataFrame) -> DataFrame:
    """Null text becomes '' at the boundary."""
    return df.fillna("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def without_internal(df: DataFrame) -> DataFrame:
    """Columns whose names start with an underscore stay inside."""
    return df.drop(*(c for c in df.columns if c.startswith("_")))
