"""Product rows from structured data in pages: JSON-LD, microdata, Open Graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dom import Page, per_page
from ..sources.nodes import attr
from .merge import first_tier

FIELDS = ["product_name", "brand", "sku", "upc", "price", "image_url", "product_url"]
# Where an identifier may stand in a JSON-LD product, first to last.
FLAT_IDS = ["gtin12", "gtin13", "gtin"]
JSONLD_IDS = ["gtin12", "gtin13", "gtin8", "gtin", "gtin14", "productID"]


def _one(x):
    """The first of a list, else the value."""
    return x[0] if isinstance(x, list) and x else x


def _str(x) -> str:
    return "" if x is None or isinstance(x, (dict, list)) else str(x)


def jsonld_products(value, nested: bool = True) -> Iterator[dict]:
    """Product objects of a JSON-LD value: itself, list elements, wrapped items, a graph's members."""
    if isinstance(value, list):
        for x in value:
            yield from jsonld_products(x, nested)
    elif isinstance(value, dict):
        kinds = value.get("@type", "")
        if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
            yield value
        else:
            for key in ("itemListElement", "item", "@graph") if nested else ("@graph",):
                yield from jsonld_products(value.get(key), nested)


def jsonld_row(item: dict, base: str, ids: list[str] = JSONLD_IDS) -> list[str] | None:
    """The fields of a product object; None without a name."""
    name = _str(item.get("name")).strip()
    if not name:
        return None
    brand, image, offer = item.get("brand"), _one(item.get("image")), _one(item.get("offers"))
    image = (image.get("url") or image.get("contentUrl")) if isinstance(image, dict) else image
    offer = offer if isinstance(offer, dict) else {}
    price, currency = _str(offer.get("price")), _str(offer.get("priceCurrency") or "USD")
    link = _str(item.get("url")) or _str(offer.get("url"))
    return [
        name, _str(brand.get("name") if isinstance(brand, dict) else brand), _str(item.get("sku")) or _str(item.get("mpn")), next((_str(item[k]) for k in ids if item.get(k)), ""),
        (f"${price}" if currency == "USD" else f"{price} {currency}") if price else "", urljoin(base, _str(image)) if image else "", urljoin(base, link) if link else "",
    ]


def jsonld(pages: DataFrame, nodes: DataFrame | None = None, nested: bool = True) -> DataFrame:
    """Product rows of all JSON-LD scripts, numbered by script and place within their page.

    A page's scripts are read in one pass over the pages, which gives the rows their numbers and URLs without a join;
    `nodes` stands for the signature that the kinds of structured data share.
    Without `nested` lists count at the top and in a graph only, and fewer keys hold an identifier.
    """
    ids = JSONLD_IDS if nested else FLAT_IDS

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        k = 0
        for i in page.all("script"):
            if page.nodes[i]["attrs"].get("type", "").lower() == "application/ld+json":
                try:
                    found = [r for x in jsonld_products(json.loads(page.source(i)), nested) if (r := jsonld_row(x, url, ids))]
                except (ValueError, RecursionError):
                    continue
                for r in found:
                    yield k, *r
                    k += 1

    return per_page(pages, "ord int, " + ", ".join(f"{f} string" for f in FIELDS), rows_of)


def _value() -> Column:
    return F.trim(F.coalesce(F.nullif(attr("content"), F.lit("")), F.nullif(F.col("text"), F.lit("")), F.lit("")))


def microdata(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Product rows of itemscopes: each property's first node below the scope, by an interval join on the page."""
    scopes = nodes.where(attr("itemtype").rlike(r"(?i)https?://schema\.org/Product")).select("page_id", F.col("pre").alias("scope"), F.col("post").alias("_b"))
    props = nodes.where(attr("itemprop") != "").select("page_id", "pre", attr("itemprop").alias("prop"), _value().alias("v"), F.coalesce(F.nullif(attr("content"), F.lit("")), F.nullif(attr("src"), F.lit("")), attr("href")).alias("source"), F.coalesce(F.nullif(attr("href"), F.lit("")), attr("content")).alias("link"))
    both = scopes.join(props, "page_id").where((F.col("pre") > F.col("scope")) & (F.col("pre") < F.col("_b")))
    first = lambda p, c="v", ok=None: F.min(F.when((F.col("prop") == p) & (F.col(c) != "") & (ok if ok is not None else F.lit(True)), F.struct("pre", c)))[c]
    digits = F.col("v").rlike(r"^\d{8,14}$")
    either = lambda *cs: F.coalesce(*cs, F.lit(""))
    r = both.groupBy("page_id", "scope").agg(
        either(first("name")).alias("product_name"), either(first("brand")).alias("brand"), either(first("sku"), first("mpn"), first("productID")).alias("sku"),
        either(*(first(p, "v", digits) for p in ("gtin12", "gtin13", "gtin8", "gtin", "gtin14", "productID"))).alias("upc"), either(first("price")).alias("_p"), either(first("priceCurrency")).alias("_c"),
        either(first("image", "source")).alias("_i"), either(first("url", "link")).alias("_u"),
    )
    price = F.when(F.col("_p") == "", "").when(F.col("_c").isin("", "USD"), F.when(F.col("_p").startswith("$"), F.col("_p")).otherwise(F.concat(F.lit("$"), F.col("_p")))).otherwise(F.concat_ws(" ", "_p", "_c"))
    from ..functions.url import absolute_url

    r = r.where("product_name <> ''").join(pages.select("page_id", "url"), "page_id")
    return r.select("page_id", F.col("scope").cast("int").alias("ord"), "product_name", "brand", "sku", "upc", price.alias("price"), absolute_url("_i", "url").alias("image_url"), absolute_url("_u", "url").alias("product_url"))


def open_graph(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """At most one product row a page, from its meta tags."""
    metas = nodes.where((F.col("tag") == "meta") & (attr("property") != "")).select("page_id", "pre", attr("property").alias("p"), F.trim(attr("content")).alias("v"))
    first = lambda *ps: F.coalesce(*(F.nullif(F.min(F.when(F.col("p") == p, F.struct("pre", "v")))["v"], F.lit("")) for p in ps), F.lit(""))
    r = metas.groupBy("page_id").agg(
        F.lower(first("og:type")).alias("_t"), first("og:title").alias("product_name"), first("og:image").alias("_i"), first("og:url").alias("_u"), first("product:price:amount", "og:price:amount").alias("_p"),
        first("product:price:currency", "og:price:currency").alias("_c"), first("product:brand", "og:brand").alias("brand"), first("product:retailer_item_id", "product:sku").alias("sku"), first("product:upc", "product:gtin").alias("upc"),
    )
    product = F.col("_t").isin("product", "og:product", "product.item") | (F.col("_p") != "") | (F.col("sku") != "") | (F.col("upc") != "")
    price = F.when(F.col("_p") == "", "").when(F.col("_c").isin("", "USD"), F.concat(F.lit("$"), F.col("_p"))).otherwise(F.concat_ws(" ", "_p", "_c"))
    from ..functions.url import absolute_url

    r = r.where(product & (F.col("product_name") != "")).join(pages.select("page_id", "url"), "page_id")
    link = F.when(F.col("_u") == "", F.coalesce("url", F.lit(""))).otherwise(absolute_url("_u", "url"))
    return r.select("page_id", F.lit(0).alias("ord"), "product_name", "brand", "sku", "upc", price.alias("price"), absolute_url("_i", "url").alias("image_url"), link.alias("product_url"))


def structured(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of each page's first kind that has any: JSON-LD, microdata, Open Graph."""
    tiers = [f(pages, nodes).withColumn("tier", F.lit(i)) for i, f in enumerate((jsonld, microdata, open_graph))]
    return first_tier(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]), "page_id")
