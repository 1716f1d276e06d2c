"""Detail pages, links and cards over the node relation: labels with values, identifiers by evidence, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import detail_upc, has_valid_check_digit, is_detail_sku
from ..functions.money import first_price
from ..functions.text import clean_title, is_category_name
from ..functions.url import absolute_url, holds_any, is_product_url, netloc, path
from ..sources.nodes import attr, in_chrome, outside
from .pages import CARD_MARKS
from .structured import jsonld

# Labels of a detail page's fields.
LABELS = {
    "case_pack": ["master case", "master pack", "case pack", "case qty", "case quantity", "units per case", "qty per case", "quantity per case", "pcs per case", "pieces per case", "inner pack", "cases per pallet"],
    "unit_size": ["unit size", "each size", "item size", "size per unit", "net weight", "net content", "net contents", "net volume", "unit of measure", "uom"],
    "sku": ["item no", "item-no", "item number", "item #", "item#", "item code", "sku", "part number", "part #", "part no", "model number", "model #", "product code", "product number", "catalog number", "catalog #", "vendor part #", "vendor item #"],
    "unit_price": ["unit price", "price per unit", "price each", "price ea", "each price", "list price", "retail price", "your price", "sale price"],
    "minimum_order_qty": ["minimum order", "min order", "minimum order qty", "min order qty", "minimum quantity", "min quantity", "min qty", "minimum qty", "order minimum", "order min"],
    "bulk_price": ["bulk price", "case price", "wholesale price", "price per case", "case rate", "volume price"],
    "upc": ["upc", "barcode", "gtin", "ean"],
    "brand": ["brand", "manufacturer"],
}
META_IDS = ["gtin14", "gtin13", "gtin12", "gtin8", "gtin", "productID", "ean", "upc", "barcode", "product:gtin", "product:upc", "product:ean"]
RICH_LABELS = {
    "upc": 2, "barcode": 2, "gtin": 2, "ean": 1, "sku": 1, "item no": 2, "item number": 2, "item #": 2, "item code": 2, "part number": 1, "case pack": 2, "master case": 2, "units per case": 2, "pack size": 1, "unit size": 1,
    "unit price": 1, "price per unit": 1, "price table": 2, "quantity break": 2, "price tier": 2, "specifications": 1, "attributes": 1,
}
RICH_FROM = 4
PRODUCT_PATHS = ["/products/", "/product/", "/item/", "/items/", "/detail/", "/p/", "/catalog/product/", "/shop/product/", "/sku/", "/prod/"]
MAYBE_PATHS = ["/pd/", "/view/", "/buy/"]
OTHER_PATHS = ["/collections/", "/category/", "/categories/", "/search", "/cart", "/checkout", "/account", "/login", "/register", "/wishlist", "/compare", "/pages/", "/blogs/", "/tag/", "/tags/", "/contact", "/about", "/faq"]
FRAME_TEXTS = ["view all", "see all", "shop all", "browse", "more", "next", "previous", "prev", "back", "home", "add to cart", "add to bag", "checkout", "login", "sign in", "contact", "about", "faq", "help"]


def label_values(nodes: DataFrame) -> DataFrame:
    """(page_id, field, value): the first label of each field in the page and what stands beside it.

    The value is the text of the next sibling element, else what follows a colon in the label's own element.
    """
    w = Window.partitionBy("page_id", "parent_id").orderBy("pre")
    beside = nodes.withColumn("_next", F.lead("text").over(w)).where((F.col("own_text") != "") & (F.length("own_text") <= 200) & ~F.col("tag").isin("script", "style"))
    label = F.regexp_replace(F.regexp_replace(F.lower("own_text"), "[-_]", " "), r"[:\s]+$", "")
    value = F.coalesce(F.when(F.length("_next").between(1, 99), F.col("_next")), F.nullif(F.trim(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1)), F.lit("")))
    fields = F.filter(F.array(*(F.when(holds_any(label, words), F.lit(f)) for f, words in LABELS.items())), lambda x: x.isNotNull())
    found = beside.select("page_id", "pre", value.alias("value"), F.explode(fields).alias("field")).where("value is not null")
    return found.groupBy("page_id", "field").agg(F.min_by("value", "pre").alias("value"))


def identifiers(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, upc, evidence): from JSON-LD, else meta tags in order, else a visible label, else a script."""
    ld = jsonld(pages, nodes).select("page_id", detail_upc(F.col("upc")).alias("upc"), F.lit(0).alias("tier"), F.col("ord").alias("at"), F.lit("json_ld").alias("evidence"))
    key = F.coalesce(F.nullif(attr("itemprop"), F.lit("")), F.nullif(attr("name"), F.lit("")), attr("property"))
    order = F.array_position(F.array(*map(F.lit, META_IDS)), key)
    meta = nodes.where((F.col("tag") == "meta") & (order > 0)).select("page_id", detail_upc(attr("content")).alias("upc"), F.lit(1).alias("tier"), order.cast("int").alias("at"), F.lit("meta").alias("evidence"))
    seen = label_values(nodes).where("field = 'upc'").select("page_id", detail_upc(F.col("value")).alias("upc"), F.lit(2).alias("tier"), F.lit(0).alias("at"), F.lit("label").alias("evidence"))
    pattern = r"""(?i)["']?(?:upc|ean|barcode|productid|gtin(?:8|12|13|14)?)["']?\s*[:=]\s*["']?(\d[\d\s-]{6,18}\d)["']?"""
    script = nodes.where((F.col("tag") == "script") & (F.lower(attr("type")) != "application/ld+json")).select("page_id", detail_upc(F.regexp_extract("own_text", pattern, 1)).alias("upc"), F.lit(3).alias("tier"), F.col("pre").alias("at"), F.lit("script").alias("evidence"))
    every = ld.unionByName(meta).unionByName(seen).unionByName(script).where("upc <> ''")
    return every.groupBy("page_id").agg(F.min_by(F.struct("upc", "evidence"), F.struct("tier", "at")).alias("b")).select("page_id", "b.upc", "b.evidence", has_valid_check_digit(F.col("b.upc")).alias("valid"))


def detail_rows(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One product row a page: structured data first, then labels, the first heading, the first price and image."""
    ld = jsonld(pages, nodes).groupBy("page_id").agg(F.min_by(F.struct("product_name", "brand", "sku", "price", "image_url"), "ord").alias("s"))
    labels = label_values(nodes).groupBy("page_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"l_{f}") for f in LABELS if f != "upc"))
    inner = outside(nodes, in_chrome())
    own = inner.groupBy("page_id").agg(
        F.min(F.when(F.col("tag") == "h1", F.struct("pre", "text")))["text"].alias("h1"),
        F.min(F.when((first_price(F.col("own_text")) != "") & ~F.col("tag").isin("script", "style"), F.struct("pre", first_price(F.col("own_text")).alias("p"))))["p"].alias("own_price"),
        F.min(F.when((F.col("tag") == "img") & (attr("src") != ""), F.struct("pre", attr("src").alias("s"))))["s"].alias("own_image"),
    )
    r = pages.select("page_id", "url")
    for part in (ld, labels, own, identifiers(pages, nodes)):
        r = r.join(part, "page_id", "left")
    some = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    image = absolute_url(F.coalesce("own_image", F.lit("")), F.col("url"))
    return r.select(
        "page_id", some(F.col("s.product_name"), clean_title(F.col("h1"))).alias("product_name"), some(F.col("s.brand"), F.col("l_brand")).alias("brand"),
        some(F.col("s.sku"), F.when(is_detail_sku(F.col("l_sku")), F.col("l_sku"))).alias("sku"), some(F.col("upc")).alias("upc"), some(F.col("s.price"), F.col("l_unit_price"), F.col("own_price")).alias("price"),
        some(F.col("l_case_pack")).alias("case_pack"), some(F.col("l_unit_size")).alias("unit_size"), some(F.col("l_minimum_order_qty")).alias("minimum_order_qty"), some(F.col("l_bulk_price")).alias("bulk_price"),
        some(F.col("s.image_url"), image).alias("image_url"), some(F.col("url")).alias("product_url"),
    )


def rich_detail(nodes: DataFrame) -> DataFrame:
    """(page_id, score, signals, is_rich): whether a page tells enough about one product."""
    has = lambda ok: F.bool_or(ok)
    rows = nodes.where("tag = 'tr'").select("page_id", "pre", "post")
    tables = nodes.where("tag = 'table'").select(F.col("page_id").alias("p"), F.col("pre").alias("a"), F.col("post").alias("b"))
    big = rows.join(tables, (F.col("page_id") == F.col("p")) & (F.col("pre") > F.col("a")) & (F.col("post") < F.col("b"))).groupBy("page_id", "a").agg(F.count("*").alias("n")).where("n >= 3").select("page_id").distinct().withColumn("spec_table", F.lit(True))
    whole = nodes.groupBy("page_id").agg(
        F.lower(F.max(F.when(F.col("parent_id").isNull(), F.col("text")))).alias("t"), has((F.lower(attr("type")) == "application/ld+json") & F.contains("own_text", F.lit("\"Product\""))).alias("ld"), F.count_if(F.col("tag") == "dt").alias("dts"),
    ).join(big, "page_id", "left")
    checks = [("json_ld_product", F.col("ld"), 3), *((k, F.contains("t", F.lit(k)), n) for k, n in RICH_LABELS.items()), ("upc_digits", F.col("t").rlike(r"\b\d{8,14}\b"), 2), ("spec_dl", F.col("dts") >= 2, 1), ("spec_table", F.coalesce("spec_table", F.lit(False)), 1)]
    score = F.lit(0)
    for _, ok, n in checks:
        score = score + F.when(ok, n).otherwise(0)
    return whole.select("page_id", score.alias("score"), F.array_compact(F.array(*(F.when(ok, F.lit(k)) for k, ok, _ in checks))).alias("signals"), (score >= RICH_FROM).alias("is_rich"))


def url_points(u: Column) -> Column:
    p = F.lower(path(u))
    slug = F.regexp_extract(F.regexp_replace(p, "/+$", ""), "([^/]*)$", 1)
    points = F.when(holds_any(p, PRODUCT_PATHS), 4).otherwise(0) + F.when(holds_any(p, MAYBE_PATHS), 2).otherwise(0) + F.when((F.length(slug) > 3) & ~slug.rlike(r"^\d+$"), 1).otherwise(0)
    return F.when(holds_any(p, OTHER_PATHS), -5).otherwise(points)


def scored_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, pre, href, score): links of a page's own host by path, text, card around them and image inside."""
    a = nodes.where((F.col("tag") == "a") & ~F.lower(F.trim(attr("href"))).rlike(r"^(javascript:|mailto:|tel:|#|$)")).select("page_id", "pre", "post", "depth", "text", F.trim(attr("href")).alias("raw"))
    a = a.join(pages.select("page_id", "url"), "page_id").withColumn("href", absolute_url("raw", "url")).where(netloc(F.col("href")) == netloc(F.col("url")))
    marks = F.concat_ws(" ", F.array_join("classes", " "), F.lower(attr("id")))
    cards = nodes.where(holds_any(marks, CARD_MARKS) & ~F.col("tag").isin("body", "html")).select(F.col("page_id").alias("p"), F.col("pre").alias("c0"), F.col("post").alias("c1"), F.col("depth").alias("cd"))
    carded = a.join(cards, (F.col("page_id") == F.col("p")) & (F.col("pre") > F.col("c0")) & (F.col("post") < F.col("c1")) & (F.col("depth") - F.col("cd") <= 8), "left_semi").select("page_id", "pre", F.lit(2).alias("card"))
    images = nodes.where("tag = 'img'").select(F.col("page_id").alias("p"), F.col("pre").alias("i"))
    framed = a.join(images, (F.col("page_id") == F.col("p")) & (F.col("i") > F.col("pre")) & (F.col("i") < F.col("post")), "left_semi").select("page_id", "pre", F.lit(2).alias("image"))
    low = F.lower("text")
    said = F.when(low == "", 0).when(holds_any(low, FRAME_TEXTS), -3).when(F.length(low) > 60, -1).otherwise(0)
    total = url_points(F.col("href")) + said + F.coalesce("card", F.lit(0)) + F.coalesce("image", F.lit(0))
    return a.join(carded, ["page_id", "pre"], "left").join(framed, ["page_id", "pre"], "left").select("page_id", "pre", "href", total.alias("score"))


def best_links(scored: DataFrame, least: int = 1) -> DataFrame:
    """Each page's best link, the first on ties, of at least `least`."""
    return scored.where(F.col("score") >= least).groupBy("page_id").agg(F.max_by(F.struct("href", "score"), F.struct("score", (-F.col("pre")).alias("f"))).alias("b")).select("page_id", "b.href", "b.score")


def cards(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Product rows of repeated card elements outside a page's frame: name, price, image and URL of each.

    An element is a card if its tag and classes repeat in the page, a class marks a product, and it holds no other card.
    A row needs two of name, URL and image, and must not be named like a category.
    """
    inner = outside(nodes, in_chrome())
    marked = inner.where(holds_any(F.array_join("classes", " "), CARD_MARKS) & (F.col("n_children") < 12)).withColumn("sig", F.concat_ws(" ", "tag", F.array_join(F.array_sort("classes"), " ")))
    often = marked.groupBy("page_id", "sig").agg(F.count("*").alias("n")).where("n >= 2")
    found = marked.join(often, ["page_id", "sig"], "left_semi").select("page_id", F.col("pre").alias("c0"), F.col("post").alias("c1"))
    below = found.select(F.col("page_id").alias("p"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    # of nested ones those without another inside count, as long as they hold a link or an image
    parts = inner.select(F.col("page_id").alias("p"), "pre", "post", "tag", "classes", "text", "own_text", "attrs")
    whole = found.join(parts, (F.col("page_id") == F.col("p")) & (F.col("pre") >= F.col("c0")) & (F.col("post") <= F.col("c1")))
    first = lambda ok, v: F.min(F.when(ok & (v != ""), F.struct("pre", v.alias("v"))))["v"]
    named = holds_any(F.array_join("classes", " "), ["name", "title"])
    rows = whole.groupBy("page_id", "c0", "c1").agg(
        F.coalesce(first(F.col("tag").isin("h1", "h2", "h3", "h4") | named, F.col("text")), first(F.col("tag") == "a", F.col("text")), first(F.col("tag") == "img", attr("alt")), F.lit("")).alias("name"),
        F.coalesce(first(F.lit(True), first_price(F.col("own_text"))), F.lit("")).alias("price"), F.coalesce(first(F.col("tag") == "img", F.coalesce(F.nullif(attr("src"), F.lit("")), attr("data-src"))), F.lit("")).alias("img"),
        F.coalesce(first((F.col("tag") == "a"), attr("href")), F.lit("")).alias("link"),
    )
    rows = rows.where((F.col("name") != "").cast("int") + (F.col("link") != "").cast("int") + (F.col("img") != "").cast("int") >= 2)
    leaf = rows.join(below, (F.col("page_id") == F.col("p")) & (F.col("c0") < F.col("d0")) & (F.col("c1") > F.col("d1")), "left_anti").join(pages.select("page_id", "url"), "page_id")
    out = leaf.select("page_id", F.col("c0").alias("ord"), clean_title(F.col("name")).alias("product_name"), "price", absolute_url("img", "url").alias("image_url"), absolute_url("link", "url").alias("product_url"))
    return out.where(~is_category_name(F.col("product_name"))).withColumn("looks_like_product", is_product_url(F.col("product_url")))
