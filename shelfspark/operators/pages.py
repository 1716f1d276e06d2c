"""What kind of page a page is, from its nodes: aggregates of features, then one cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import is_blocked_page
from ..functions.url import holds_any
from ..sources.nodes import attr, in_chrome, outside

# Marks of cards, of catalog lists, of scripts that build pages.
CARD_MARKS = ["product", "item", "card", "tile", "grid-item", "listing", "result", "catalogue", "prod-"]
LIST_MARKS = ["product-list", "item-list", "catalog", "catalogue", "price-list", "order-form", "product-row", "item-row"]
FRAMEWORKS = r"""__NEXT_DATA__|window\.__nuxt__|window\.React|id=["']app["']|id=["']root["']|ng-app|ng-controller|data-reactroot|vue-app|data-bind=|ko\.applyBindings|ember-application|data-ember"""
SCRIPTED = ["data-bind=", "ko.applyBindings", "ng-app", "ng-controller", "__NEXT_DATA__", "__NUXT__", "data-reactroot", "__APOLLO_STATE__", "graphql"]
BLOCKED = ["access denied", "403 forbidden", "captcha", "are you a robot", "please enable javascript", "checking your browser"]
LOGIN_ACTIONS, LOGIN_MARKS = ["login", "sign-in", "signin", "auth"], ["login-form", "signin-form", "auth-form", "login-page"]
WRAPPER_CHILDREN, LEAST = 12, 3


def _marks() -> Column:
    return F.concat_ws(" ", F.array_join("classes", " "), F.lower(attr("id")))


def features(pages: DataFrame, nodes: DataFrame, jsonld: DataFrame | None = None) -> DataFrame:
    """A row of features for each page; `jsonld` (page_id, rows) counts structured products."""
    classes = F.array_join("classes", " ")
    cards = nodes.where(holds_any(_marks(), CARD_MARKS) & (F.col("n_children") < WRAPPER_CHILDREN)).groupBy("page_id", "tag", F.array_join(F.array_sort("classes"), " ").alias("sig")).agg(F.count("*").alias("n"))
    cards = cards.groupBy("page_id").agg(F.max("n").alias("cards"))
    lists = nodes.where(F.col("tag").isin("table", "ul", "ol", "div") & holds_any(classes, LIST_MARKS)).select("page_id", F.col("node_id").alias("parent_id"))
    listed = nodes.where(F.col("tag").isin("tr", "li")).join(lists, ["page_id", "parent_id"], "left_semi").groupBy("page_id", "tag", F.array_join(F.array_sort("classes"), " ").alias("sig")).agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max("n").alias("listed"))
    cells = nodes.where(F.col("tag").isin("td", "th")).groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n >= 2")
    worded = nodes.where((F.col("tag") == "tr") & holds_any(F.lower("text"), ["$", "price", "sku", "item", "upc", "pack"])).join(cells, ["page_id", "node_id"], "left_semi").groupBy("page_id").agg(F.count("*").alias("worded"))
    form = (F.col("tag") == "form") & holds_any(F.lower(attr("action")), LOGIN_ACTIONS)
    password = (F.col("tag") == "input") & (attr("type") == "password")
    login = outside(nodes, in_chrome()).where(form | password | holds_any(_marks(), LOGIN_MARKS)).groupBy("page_id").agg(F.lit(True).alias("login"))
    whole = nodes.groupBy("page_id").agg(
        F.coalesce(F.max(F.when(F.col("tag") == "body", F.length("text"))), F.lit(0)).alias("body_length"), F.bool_or(F.col("tag") == "body").alias("has_body"), F.count_if(F.col("tag") == "h1").alias("h1"),
        F.bool_or(holds_any(classes, ["price", "cost"]) & ~F.col("tag").isin("script", "style")).alias("price_class"), F.bool_or(holds_any(classes, ["product", "item", "card", "catalog"])).alias("product_class"),
        F.bool_or(F.col("own_text").rlike(r"\$\d+\.\d{2}") & ~F.col("tag").isin("script", "style")).alias("price_text"), F.bool_or(F.contains("own_text", F.lit("$")) & ~F.col("tag").isin("script", "style")).alias("dollar"),
        F.count_if(holds_any(classes, ["product-name", "product-title", "item-name", "item-title", "product-description"])).alias("names"),
        F.count_if((F.col("tag") == "img") & holds_any(F.lower(attr("src")), ["product", "item", "catalog"])).alias("images"),
    )
    base = pages.select("page_id", F.coalesce("html", F.lit("")).rlike(FRAMEWORKS).alias("framework"), holds_any(F.coalesce("html", F.lit("")), SCRIPTED).alias("scripted"), holds_any(F.lower(F.coalesce("html", F.lit(""))), BLOCKED).alias("blocked"), is_blocked_page(F.col("html")).alias("challenge"))
    counted = jsonld.groupBy("page_id").agg(F.count("*").alias("structured")) if jsonld is not None else None
    out = base
    for part in (whole, cards, listed, worded, login, counted):
        if part is not None:
            out = out.join(part, "page_id", "left")
    if counted is None:
        out = out.withColumn("structured", F.lit(0))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("cards", "worded", "listed", "structured", "h1", "body_length", "names", "images")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("login", "has_body", "price_class", "product_class", "price_text", "dollar")}
    return out.withColumns(numbers | flags).withColumn("catalog_rows", F.when(F.col("listed") >= LEAST, F.col("listed")).otherwise(F.col("worded"))).drop("listed", "worded")


def classify(f: DataFrame) -> DataFrame:
    """page_id, page_type and confidence: the first of the rules that holds."""
    cards, rows = F.col("cards"), F.col("catalog_rows")
    few = (cards < LEAST) & (rows < LEAST)
    scripted = ~F.col("has_body") | (F.col("framework") & ((F.col("body_length") < 500) | (F.col("product_class") & ~F.col("price_text"))))
    rules = [
        (F.col("login") & few, "login_required", F.lit(0.99)),
        (scripted, "js_app", F.lit(0.90)),
        ((F.col("structured") == 1) & (cards < LEAST), "detail_page", F.lit(0.95)),
        ((F.col("h1") == 1) & few & F.col("price_class"), "detail_page", F.lit(0.65)),
        ((rows >= LEAST) & (rows > cards), "row_catalog", F.bround(F.least(F.lit(0.95), 0.60 + rows * 0.005), 2)),
        (cards >= LEAST, "listing_grid", F.bround(F.least(F.lit(0.90), 0.55 + cards * 0.01), 2)),
    ]
    kind, sure = F, F
    for i, (ok, name, confidence) in enumerate(rules):
        kind, sure = (F if i == 0 else kind).when(ok, name), (F if i == 0 else sure).when(ok, confidence)
    return f.select("page_id", kind.otherwise("listing_grid").alias("page_type"), sure.otherwise(0.35).alias("confidence"))


def needs_browser(f: DataFrame) -> DataFrame:
    """Whether a page's HTML alone tells too little."""
    bare = (F.col("body_length") < 500) & ~(F.col("product_class") & F.col("dollar"))
    return f.select("page_id", (F.col("blocked") | F.col("scripted") | (F.col("product_class") & ~F.col("dollar")) | bare).alias("needs_browser"))


def has_product_content(f: DataFrame) -> DataFrame:
    return f.select("page_id", (F.col("price_text") | (F.col("names") >= LEAST) | (F.col("images") >= LEAST)).alias("has_products"))


# How a page's source says that it is one product's.
DETAIL_SIGNALS = ['"@type": "Product"', '"@type":"Product"', 'itemtype="http://schema.org/Product"', 'itemtype="https://schema.org/Product"']


def is_detail_page(pages: DataFrame, f: DataFrame) -> DataFrame:
    """Whether a page is one product's: its source says so, or it has one main heading and a price and is no listing."""
    said = pages.select("page_id", holds_any(F.coalesce("html", F.lit("")), DETAIL_SIGNALS).alias("said"))
    alone = (F.col("h1") == 1) & (F.col("cards") < LEAST) & (F.col("catalog_rows") < LEAST) & F.col("price_class")
    return f.join(said, "page_id").select("page_id", (F.col("said") | alone).alias("is_detail"))


def shows_products(nodes: DataFrame) -> DataFrame:
    """Whether a price or an item number stands in a page's visible text."""
    visible = F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("pre", "text")))["text"])  # the top elements of one page
    top = nodes.where(F.col("parent_id").isNull() & ~F.col("tag").isin("script", "style", "noscript")).groupBy("page_id").agg(visible.alias("t"))
    every = nodes.select("page_id").distinct().join(top, "page_id", "left")
    found = F.col("t").rlike(r"\$\d+\.\d{2}") | F.col("t").rlike(r"(?i)\b(?:SKU|Item\s*#|Part\s*#|UPC)\s*[:\s]?\s*[A-Z0-9]{3,}")
    return every.select("page_id", F.coalesce(found, F.lit(False)).alias("shows_products"))


def top_patterns(nodes: DataFrame, most: int = 5, pattern: Column | None = None) -> DataFrame:
    """(page_id, pattern, n, rank): a page's most common tag and classes, the first seen on ties."""
    kind = pattern if pattern is not None else F.concat_ws(".", "tag", F.array_join(F.array_sort(F.array_distinct("classes")), "."))
    counted = nodes.groupBy("page_id", kind.alias("pattern")).agg(F.count("*").alias("n"), F.min("pre").alias("first"))
    w = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("first")


# Words of column headers, by meaning, in the order that meanings are tried.
HEADERS = {
    "image": ["image", "img", "photo", "pic", "picture", "thumbnail", "thumb"],
    "product_name": ["description", "product description", "item description", "product name", "item name", "name", "product", "title"],
    "sku": ["item no", "item number", "item #", "item-no", "item code", "part number", "part no", "part #", "catalog number", "catalog #", "model number", "model #", "vendor part", "sku", "item", "part", "model", "code"],
    "qty": ["qty order", "qty per order", "quantity order", "order qty", "order quantity", "min order qty", "min order quantity", "min order", "min qty", "minimum order", "qty", "quantity"],
    "order_target": ["order", "quick order", "add to order", "buy", "view detail", "view details", "detail", "details", "more info", "info"],
    "price": ["unit price", "each price", "price each", "price per unit", "list price", "your price", "sale price", "net price", "price", "cost", "each", "ea", "rate", "amount"],
    "case_pack": ["case pack", "master case", "units per case", "qty per case", "case qty", "inner pack", "pack size", "case", "pack"],
    "brand": ["manufacturer", "vendor", "brand name", "brand", "mfg", "make"],
    "upc": ["upc code", "upc/ean", "upc", "barcode", "gtin", "ean"],
    "extension": ["extension", "extention", "ext price", "extended price", "ext", "total"],
}


def header_meaning(c: Column) -> Column:
    """The meaning of a column header, null for none."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[:\-_/\\|]+", " "), r"\s+", " "))
    out = F
    for i, (meaning, words) in enumerate(HEADERS.items()):
        exact = text.isin(words)
        inside = text.rlike("|".join(rf"\b{w.replace('#', '[#]')}" + (r"\b" if w[-1].isalnum() else r"(?=\w)") for w in words))
        out = (F if i == 0 else out).when(exact | inside, meaning)
    return out


def table_rows(nodes: DataFrame) -> DataFrame:
    """Product rows of each page's best table: page_id, row_pre and a column for each meaning.

    A header row has th cells, or two known headers and no price; a table needs two known columns, a quarter of all,
    and two rows below. Tables are told apart by the innermost table around a row.
    """
    tables = nodes.where(F.col("tag") == "table").select("page_id", F.col("pre").alias("table_pre"), F.col("post").alias("_b"))
    trs = nodes.where(F.col("tag") == "tr").select("page_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("row_pre"), F.col("post").alias("row_post"))
    owned = trs.join(tables, "page_id").where((F.col("row_pre") > F.col("table_pre")) & (F.col("row_post") < F.col("_b"))).groupBy("page_id", "parent_id", "row_pre").agg(F.max("table_pre").alias("table_pre"))
    cells = nodes.where(F.col("tag").isin("td", "th")).join(owned, ["page_id", "parent_id"]).select("page_id", "table_pre", "row_pre", "pre", "tag", "text", header_meaning(F.col("text")).alias("meaning"))
    grid = cells.groupBy("page_id", "table_pre", "row_pre").agg(F.array_sort(F.collect_list(F.struct("pre", "tag", "text", "meaning"))).alias("cells"))  # one row of one table
    known = F.filter("cells", lambda x: x["meaning"].isNotNull())
    grid = grid.withColumn("header", F.exists("cells", lambda x: x["tag"] == "th") | ((F.size(known) >= 2) & ~F.exists("cells", lambda x: x["text"].rlike(r"\$[\d,]+\.\d{2}"))))
    heads = grid.where("header").groupBy("page_id", "table_pre").agg(F.min_by(F.struct("row_pre", "cells"), "row_pre").alias("h"))
    good = heads.select("page_id", "table_pre", F.col("h.row_pre").alias("head_pre"), F.col("h.cells").alias("head"), (F.size(F.filter("h.cells", lambda x: x["meaning"].isNotNull())) / F.size("h.cells")).alias("confidence"), F.size(F.filter("h.cells", lambda x: x["meaning"].isNotNull())).alias("n_known")).where("n_known >= 2 and confidence >= 0.25")
    data = grid.where("not header").join(good, ["page_id", "table_pre"])
    enough = data.groupBy("page_id", "table_pre").agg(F.count("*").alias("n"), F.first("confidence").alias("c")).where("n >= 2").groupBy("page_id").agg(F.max_by("table_pre", F.struct("c", (-F.col("table_pre")).alias("f"))).alias("table_pre"))
    best = data.join(enough, ["page_id", "table_pre"])
    at = lambda meaning: F.get(F.filter(F.transform("head", lambda x, i: F.when(x["meaning"] == meaning, i)), lambda i: i.isNotNull()), 0)
    value = lambda m: F.coalesce(F.get("cells", at(m))["text"], F.lit(""))
    return best.select("page_id", "row_pre", "confidence", *(value(m).alias(m) for m in HEADERS if m != "image"))
