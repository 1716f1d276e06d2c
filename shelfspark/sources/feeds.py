"""Product feeds as nested JSON, one row for each variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.money import minor_unit_money, money
from ..functions.text import clean_string, strip_html

VARIANT_FEED = """id string, title string, vendor string, handle string, body_html string, tags string, images array<struct<id:string,src:string>>,
    variants array<struct<id:string,name:string,sku:string,barcode:string,price:string,available:boolean,image_id:string>>"""
ATTRIBUTE_FEED = """id string, name string, slug string, sku string, barcode string, upc string, ean string, gtin string, global_unique_id string, description string, short_description string, is_in_stock boolean, permalink string,
    prices struct<currency_symbol:string,currency_minor_unit:string,price:string,sale_price:string,regular_price:string>, categories array<struct<name:string>>, tags array<struct<name:string>>,
    images array<struct<src:string,thumbnail:string>>, attributes array<struct<name:string,taxonomy:string,terms:array<struct<name:string,slug:string>>>>"""
# Tags that are no category.
OTHER_TAGS = ["Specials", "In Stock", "New Arrivals", "P&G", "P&G products", "PG", "Procter & Gamble", "Unilever"]


def _clean(c: Column) -> Column:
    return clean_string(c, entities=False)


def _first(a: Column) -> Column:
    return F.coalesce(F.get(a, 0), F.lit(""))


def _stock(c: Column) -> Column:
    return F.when(c, "Available").when(~c, "Unavailable").otherwise("")


def variant_rows(feed: DataFrame, body: str = "body") -> DataFrame:
    """Rows of feed products (ord, root, JSON text): one for each variant, one for a product without.

    Brand, case size and categories come from tags, which may be a list or one text with commas; a variant's image
    is the one it names, else the product's first.
    """
    p = feed.select("ord", "root", F.from_json(body, VARIANT_FEED).alias("p")).select("ord", "root", "p.*")
    listed = F.when(F.trim("tags").startswith("["), F.from_json("tags", "array<string>")).otherwise(F.split("tags", ","))
    p = p.withColumn("_tags", F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), _clean), lambda t: t != ""))
    brand = _first(F.filter("_tags", lambda t: t.rlike("(?i)^Brand_")))
    vendor = F.when(F.lower(_clean(F.col("vendor"))) == "rego trading inc", "").otherwise(_clean(F.col("vendor")))
    case = _first(F.filter("_tags", lambda t: t.rlike("(?i)^case/")))
    other = F.filter("_tags", lambda t: ~t.rlike("(?i)^(Brand_|case/)") & ~t.isin(OTHER_TAGS) & ~t.rlike("(?i)products$"))
    p = p.withColumns(
        {
            "brand": F.when(brand != "", F.translate(F.regexp_replace(brand, "(?i)^Brand_", ""), "_", " ")).otherwise(vendor),
            "case_pack": F.when(case != "", F.regexp_replace(case, "(?i)^case/", "")).otherwise(F.regexp_extract(_clean(F.col("title")), r"(?i)(?:^|\s|-)/?(\d+)\s*(?:pk|ct|case)\b", 1)),
            "category": F.array_join(other, "; "),
            "description": strip_html(F.col("body_html"), entities=False),
            "source_product_id": F.coalesce("id", F.lit("")),
            "_first_image": F.coalesce(F.get("images", 0)["src"], F.lit("")),
            "v": F.explode_outer("variants"),
        }
    )
    own = F.get(F.filter("images", lambda i: i["id"] == F.col("v.image_id")), 0)["src"]
    code = ids.barcode_or_raw(F.coalesce(F.col("v.barcode"), F.lit("")))
    rows = p.select(
        "ord", _clean(F.coalesce(F.nullif("v.name", F.lit("")), F.col("title"))).alias("product_name"), "brand", _clean(F.col("v.sku")).alias("sku"), code.alias("upc"), money(F.col("v.price")).alias("price"), "case_pack",
        F.coalesce(own, F.col("_first_image")).alias("image_url"), F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/products/"), F.coalesce("handle", F.lit(""))).alias("product_url"), "category", "description",
        _stock(F.col("v.available")).alias("availability"), "source_product_id", F.coalesce(F.col("v.id"), F.lit("")).alias("source_variant_id"), F.lit("Product feed").alias("source_platform"),
        F.array_join("_tags", "; ").alias("tags"), F.when(code != "", "supplier_feed").otherwise("").alias("upc_source"), F.when(code != "", "0").otherwise("1").alias("missing_upc"),
    )
    return ids.normalize_products(rows)


def attribute_rows(feed: DataFrame, body: str = "body") -> DataFrame:
    """Rows of store-API products (ord, root, JSON text), with identifiers from keys, attributes, texts or a numeric item number."""
    p = feed.select("ord", "root", F.from_json(body, ATTRIBUTE_FEED).alias("p")).select("ord", "root", "p.*")
    attribute = lambda a: F.lower(_clean(F.coalesce(F.nullif(a["name"], F.lit("")), a["taxonomy"])))
    terms = lambda ok: F.filter(F.flatten(F.transform(F.filter(F.coalesce("attributes", F.from_json(F.lit("[]"), "array<struct<name:string,taxonomy:string,terms:array<struct<name:string,slug:string>>>>")), lambda a: attribute(a).rlike(ok)), lambda a: F.transform(a["terms"], lambda t: _clean(F.coalesce(F.nullif(t["name"], F.lit("")), t["slug"]))))), lambda t: t != "")
    brand_category = F.get(F.filter(F.transform("categories", lambda c: _clean(c["name"])), lambda c: c.rlike(r"(?i)\bbrand")), 0)
    keyed = [(F.when(F.length(ids.barcode(F.col(k))) > 0, ids.barcode(F.col(k))), F.lit(f"feed_{k}")) for k in ("global_unique_id", "barcode", "upc", "ean", "gtin")]
    from_terms = F.get(F.filter(F.transform(terms("upc|ean|gtin|barcode"), ids.barcode), lambda t: t != ""), 0)
    texts = [(F.nullif(ids.labelled_identifier(strip_html(F.col(k), entities=False)), F.lit("")), F.lit(f"feed_{k}")) for k in ("description", "short_description")]
    numeric = F.nullif(ids.barcode(F.col("sku")), F.lit(""))
    found = [*keyed, (from_terms, F.lit("feed_attribute")), *texts, (numeric, F.lit("numeric_sku"))]
    upc = F.coalesce(*(v for v, _ in found), F.lit(""))
    source = F.coalesce(*(F.when(v.isNotNull(), name) for v, name in found), F.lit(""))
    joined = lambda c: F.array_join(F.filter(F.transform(c, lambda x: _clean(x["name"])), lambda x: x != ""), "; ")
    price = F.coalesce(*(F.nullif(f"prices.{k}", F.lit("")) for k in ("price", "sale_price", "regular_price")))
    rows = p.select(
        "ord", _clean(F.col("name")).alias("product_name"), F.coalesce(F.get(terms("brand|manufacturer"), 0), F.btrim(F.regexp_replace(brand_category, r"(?i)\bbrands?\b", ""), F.lit(" -:")), F.lit("")).alias("brand"), _clean(F.col("sku")).alias("sku"),
        upc.alias("upc"), minor_unit_money(F.coalesce(price, F.lit("")), F.coalesce(F.col("prices.currency_minor_unit"), F.lit("2")), F.coalesce(F.col("prices.currency_symbol"), F.lit("$"))).alias("price"),
        F.coalesce(F.nullif(F.get("images", 0)["src"], F.lit("")), F.get("images", 0)["thumbnail"], F.lit("")).alias("image_url"),
        F.coalesce(F.nullif("permalink", F.lit("")), F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/product/"), F.coalesce("slug", "id", F.lit("")))).alias("product_url"), F.coalesce(joined("categories"), F.lit("")).alias("category"),
        strip_html(F.coalesce(F.nullif("short_description", F.lit("")), F.col("description")), entities=False).alias("description"), _stock(F.col("is_in_stock")).alias("availability"), F.coalesce("id", F.lit("")).alias("source_product_id"),
        F.lit("Product feed").alias("source_platform"), F.coalesce(joined("tags"), F.lit("")).alias("tags"), source.alias("upc_source"), F.when(upc != "", "0").otherwise("1").alias("missing_upc"),
    )
    return ids.normalize_products(rows)
