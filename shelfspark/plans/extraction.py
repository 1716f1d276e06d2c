"""Queries of the extraction operators over captured pages, feeds and payloads.

Their inputs are inline rows; what they must give is stated as rows as well.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import pages as page_ops
from ..operators import detail as detail_ops
from ..operators import payloads, structured
from ..sources import feeds
from ..sources import nodes as dom
from .base import dealt, load, values
from .queries import query

BASE = "https://shop.example/list"
LD = {"@context": "https://schema.org", "@type": "ItemList", "itemListElement": [
    {"@type": "ListItem", "position": 1, "item": {"@type": "Product", "name": "Pretzel Case", "sku": "PRETZ-24", "brand": {"@type": "Brand", "name": "Acme"}, "gtin13": "1234567890123", "image": ["/i/pretzel.jpg"], "url": "/p/pretzel", "offers": {"price": "24.99", "priceCurrency": "USD"}}},
    {"@type": "ListItem", "position": 2, "item": {"@type": "Product", "name": "Soda", "mpn": "S-1", "brand": "Fizz", "offers": [{"price": 9.5, "priceCurrency": "CAD", "url": "/p/soda"}]}},
]}
PAGES = [
    (1, BASE, f'<html><head><script type="application/ld+json">{json.dumps(LD)}</script></head><body><h1>List</h1></body></html>'),
    (2, BASE, '<body><div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Blue Syrup</span><span itemprop="brand" itemscope><b itemprop="name">Sweet</b></span><meta itemprop="sku" content="SY-9"><meta itemprop="gtin12" content="012345678905"><img itemprop="image" src="/i/s.png"><a itemprop="url" href="/p/syrup">more</a><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price">4.25</span><meta itemprop="priceCurrency" content="USD"></div></div></body>'),
    (3, BASE, '<head><meta property="og:type" content="product"><meta property="og:title" content="Maple Box"><meta property="product:price:amount" content="9.50"><meta property="product:price:currency" content="CAD"><meta property="product:brand" content="Leaf"><meta property="og:image" content="/i/m.jpg"></head><body></body>'),
    (4, BASE, '<body><nav><form action="/login"><input type="password"></form></nav><table><thead><tr><th>Image</th><th>Item No</th><th>Description</th><th>Qty Order</th><th>Unit Price</th><th>Case Pack</th></tr></thead><tbody><tr><td></td><td>9981796</td><td>Blue Towel</td><td>1</td><td>$1.75</td><td>144 EA</td></tr><tr><td></td><td>9981797</td><td>Red Towel</td><td>2</td><td>$2.10 </td><td>12</td></tr><tr><td></td><td>9981798</td><td>Green <b>Towel</b></td><td>2</td><td>$3.00</td><td>6</td></tr></tbody></table><div class="pagination"><a href="?page=1">1</a><a href="?page=2">2</a><a href="?page=13">13</a><a href="?page=2" rel="next">Next</a></div></body>'),
    (5, BASE, "<body>" + "".join(f'<div class="product-card"><a href="/p/{k}">Card {k}</a><span class="price">${k}.00</span></div>' for k in range(1, 6)) + f'<p>{"words " * 120}</p></body>'),
    (6, BASE, '<body><form action="/signin"><input type="password"></form></body>'),
    (7, BASE, '<body><div id="root"></div><script>window.__NEXT_DATA__ = {}</script></body>'),
    (8, BASE, f'<body><h1>One Thing</h1><span class="price">$5.00</span><p>{"text " * 150}</p></body>'),
    (9, BASE, None),
]
_S = ["page_id", "product_name", "brand", "sku", "upc", "price", "image_url", "product_url"]


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def expect(rows: list[tuple], names: list[str], longs: tuple[str, ...] = ("page_id",), ints: tuple[str, ...] = (), doubles: tuple[str, ...] = ()) -> str:
    kind = lambda c: "BIGINT" if c in longs else "INTEGER" if c in ints else "DOUBLE" if c in doubles else ""
    return f"SELECT {', '.join(f'CAST({c} AS {kind(c)}) AS {c}' if kind(c) else c for c in names)} FROM {values(rows, names)}"


_LD_ROWS = [(1, "Pretzel Case", "Acme", "PRETZ-24", "1234567890123", "$24.99", "https://shop.example/i/pretzel.jpg", "https://shop.example/p/pretzel"), (1, "Soda", "Fizz", "S-1", "", "9.5 CAD", "", "https://shop.example/p/soda")]
_MICRO = [(2, "Blue Syrup", "Sweet", "SY-9", "012345678905", "$4.25", "https://shop.example/i/s.png", "https://shop.example/p/syrup")]
_OG = [(3, "Maple Box", "Leaf", "", "", "9.50 CAD", "https://shop.example/i/m.jpg", BASE)]


@query("q_jsonld", expect(_LD_ROWS, _S))
def jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    return structured.jsonld(p, dom.nodes(p)).select(_S)


@query("q_microdata", expect(_MICRO, _S))
def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    return structured.microdata(p, dom.nodes(p)).select(_S)


@query("q_opengraph", expect(_OG, _S))
def opengraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    return structured.open_graph(p, dom.nodes(p)).select(_S)


@query("q_structured_tiers", expect(_LD_ROWS + _MICRO + _OG, _S))
def structured_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    return structured.structured(p, dom.nodes(p)).select(_S)


@query("q_table_rows", expect([(4, "9981796", "Blue Towel", "1", "$1.75", "144 EA"), (4, "9981797", "Red Towel", "2", "$2.10", "12"), (4, "9981798", "Green Towel", "2", "$3.00", "6")], ["page_id", "sku", "product_name", "qty", "price", "case_pack"]))
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.table_rows(dom.nodes(_pages(spark))).select("page_id", "sku", "product_name", "qty", "price", "case_pack")


_CLASSES = [(1, "listing_grid", 0.35), (2, "listing_grid", 0.35), (3, "listing_grid", 0.35), (4, "row_catalog", 0.62), (5, "listing_grid", 0.6), (6, "login_required", 0.99), (7, "js_app", 0.9), (8, "detail_page", 0.65), (9, "js_app", 0.9)]


@query("q_page_classes", expect(_CLASSES, ["page_id", "page_type", "confidence"], doubles=("confidence",)))
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    n = dom.nodes(p)
    return page_ops.classify(page_ops.features(p, n, structured.jsonld(p, n)))


@query("q_needs_browser", expect([(1, "true"), (2, "true"), (3, "true"), (4, "true"), (5, "false"), (6, "true"), (7, "true"), (8, "false"), (9, "true")], ["page_id", "needs_browser"]).replace("needs_browser FROM", "needs_browser = 'true' AS needs_browser FROM"))
def needs_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark)
    return page_ops.needs_browser(page_ops.features(p, dom.nodes(p)))


@query("q_page_numbers", expect([(4, 13, "?page=2", 0)], ["page_id", "highest", "next_href", "tier"], ints=("highest", "tier")))
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dom.nodes(_pages(spark))
    return dom.highest_page_button(n).join(dom.next_links(n), "page_id").select("page_id", "highest", "next_href", "tier")


@query("q_page_links", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="[^"#][^"]*"')) AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, '<a\s[^>]*href="[^"#][^"]*"')) > 0""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.links(dom.nodes(load(spark, sf_dir, "pages"))).groupBy("page_id").agg(F.count("*").alias("n"))


@query("q_page_nodes")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element counts of the captured pages; the tests compare the parser with a plain one."""
    return dom.nodes(load(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("q_visible_text")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dom.nodes(load(spark, sf_dir, "pages"))
    return dom.outside(n, dom.in_chrome()).where("tag = 'body'").select("page_id", F.length("text").alias("n_chars"))


FEED_A = [
    (1, "https://s.example", json.dumps({"id": 100, "title": "Bandage Box", "vendor": "ReGo Trading Inc", "handle": "bandage", "body_html": "<p>Soft <b>pads</b></p>", "tags": ["Brand_3M", "case/1", "Health Care", "RegInv", "In Stock"], "images": [{"id": 7, "src": "https://i/7.jpg"}, {"id": 8, "src": "https://i/8.jpg"}], "variants": [{"id": 200, "name": "Bandage Box Small", "sku": "B-1", "barcode": "012345678905", "price": "13.97", "available": False, "image_id": 8}, {"id": 201, "sku": "B-2", "price": "1397", "available": True}]})),
    (2, "https://s.example/", json.dumps({"id": 101, "title": "Plain 12ct", "vendor": "Own", "handle": "plain", "tags": "Brand_Big_Co, Snacks"})),
]
_FA = ["ord", "product_name", "brand", "sku", "upc", "price", "case_pack", "image_url", "product_url", "category", "description", "availability", "source_variant_id", "missing_upc"]
_FA_ROWS = [
    (1, "Bandage Box Small", "3M", "B-1", "012345678905", "$13.97", "1", "https://i/8.jpg", "https://s.example/products/bandage", "Health Care; RegInv", "Soft pads", "Unavailable", "200", "0"),
    (1, "Bandage Box", "3M", "B-2", "", "$13.97", "1", "https://i/7.jpg", "https://s.example/products/bandage", "Health Care; RegInv", "Soft pads", "Available", "201", "1"),
    (2, "Plain 12ct", "Big Co", "", "", "", "12", "", "https://s.example/products/plain", "Snacks", "", "", "", "1"),
]


@query("q_feed_variants", expect(_FA_ROWS, _FA, longs=("ord",)))
def feed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.variant_rows(spark.createDataFrame(FEED_A, "ord long, root string, body string")).select(_FA)


FEED_B = [
    (1, "https://w.example", json.dumps({"id": 9, "name": "Wipes", "slug": "wipes", "sku": "W-9", "short_description": "<p>Wet</p>", "is_in_stock": True, "prices": {"currency_symbol": "$", "currency_minor_unit": 2, "price": "1999"}, "categories": [{"name": "Home"}, {"name": "Care"}], "tags": [{"name": "new"}], "images": [{"src": "https://i/w.jpg"}], "attributes": [{"name": "Brand", "terms": [{"name": "Acme"}]}, {"name": "UPC", "terms": [{"name": "012345678905"}]}], "permalink": "https://w.example/p/wipes"})),
    (2, "https://w.example", json.dumps({"id": 10, "name": "Soap", "sku": "12345670", "description": "EAN: 4006381333931", "categories": [{"name": "Brand: Clean"}]})),
]
_FB = ["ord", "product_name", "brand", "upc", "upc_source", "price", "image_url", "product_url", "category", "availability"]
_FB_ROWS = [(1, "Wipes", "Acme", "012345678905", "feed_attribute", "$19.99", "https://i/w.jpg", "https://w.example/p/wipes", "Home; Care", "Available"), (2, "Soap", "Clean", "4006381333931", "feed_description", "", "", "https://w.example/product/10", "Brand: Clean", "")]


@query("q_feed_attributes", expect(_FB_ROWS, _FB, longs=("ord",)))
def feed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.attribute_rows(spark.createDataFrame(FEED_B, "ord long, root string, body string")).select(_FB)


PAYLOADS = [(1, "https://b.example/shop", json.dumps({"data": {"products": [{"productName": "Syrup Bottle", "brandName": "Sweet", "itemNumber": "24152", "gtin13": "1234567890123", "unitPrice": "4.5", "pdpUrl": "/product/syrup", "imageUrl": "/i/s.jpg"}], "media": [{"url": "/i/x.jpg", "id": "m1"}]}})), (2, "https://b.example", "not json")]


@query("q_payload_walk", expect([(1, "Syrup Bottle", "Sweet", "24152", "1234567890123", "$4.5", "https://b.example/i/s.jpg", "https://b.example/product/syrup")], _S))
def payload_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.walk_payloads(spark.createDataFrame(PAYLOADS, "page_id long, url string, body string")).select(_S)


MARKDOWN = """1. [![Syrup image](/i/1.jpg)](https://m.example/syrup-24152)
SY-24152
$4.50
## [Blue *Syrup*](https://m.example/syrup-24152)
2. [![Red Towel](/i/2.jpg)](/red-towel-77)
In Cart
$ 1,200.00
3. [![Again](/i/3.jpg)](https://m.example/syrup-24152/)
4. [![Cart](/i/4.jpg)](https://m.example/cart/x)
"""
_MD = ["page_id", "product_name", "sku", "price", "image_url", "product_url"]


@query("q_markdown_cards", expect([(1, "Blue Syrup", "SY-24152", "$4.50", "https://m.example/i/1.jpg", "https://m.example/syrup-24152"), (1, "Red Towel", "", "$1,200.00", "https://m.example/i/2.jpg", "https://m.example/red-towel-77")], _MD))
def markdown_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.markdown_cards(spark.createDataFrame([(1, "https://m.example/", MARKDOWN)], "page_id long, url string, body string")).select(_MD)


@query("q_link_rows", expect([(1, "Syrup Bottle", "https://m.example/product/syrup-bottle.html"), (1, "Blue Cup", "https://m.example/item/blue_cup")], ["page_id", "product_name", "product_url"]))
def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ["/product/syrup-bottle.html", "/product/syrup-bottle.html#top", "https://m.example/item/blue_cup", "mailto:a@b", "/category/x/product/1", "https://other.example/product/1", "/about"]
    return payloads.link_rows(spark.createDataFrame([(1, "https://m.example/", links)], "page_id long, url string, links array<string>")).select("page_id", "product_name", "product_url")


ANSWERS = [(1, "https://l.example/c/", '```json\n{"products": [{"name": "Tea  Box", "manufacturer": "Leaf", "model": "T-1", "gtin": "00012345678905", "price": "$3", "url": "p/tea"}, {"name": "205 results for tea"}, {"title": "Tea Box", "url": "p/tea"}]}\n```'), (2, "https://l.example", '[{"name": "Cup", "price": 4}]'), (3, "https://l.example", "nothing")]


@query("q_model_rows", expect([(1, "Tea Box", "Leaf", "T-1", "00012345678905", "$3", "", "https://l.example/c/p/tea"), (2, "Cup", "", "", "", "4", "", "")], _S))
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.model_rows(spark.createDataFrame(ANSWERS, "page_id long, url string, body string")).select(_S)


_TITLES = [(1, "Tootsie Roll Pops 100 ct"), (2, "kraft mac and cheese, 12/7.25 OZ"), (3, "Last Purchased 12 case Blue Soap | "), (4, "An ordinary long product title here"), (5, "")]


@query("q_strengthen", expect([(1, "TOOTSIE ROLL", "100", "Tootsie Roll Pops 100 ct"), (2, "KRAFT", "", "kraft mac and cheese, 12/7.25 OZ"), (3, "", "", "12 case Blue Soap |"), (4, "", "", "An ordinary long product title here"), (5, "", "", "")], ["ord", "brand", "case_count", "clean"], longs=("ord",)).replace("'12 case Blue Soap |'", "'Blue Soap'"))
def strengthen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    brand = text.title_brand(t)
    return spark.createDataFrame(_TITLES, "ord long, title string").select("ord", brand.alias("brand"), text.case_count(t).alias("case_count"), text.clean_title(t).alias("clean"))


_NAMES = [(1, "Family Care : Dishwashing", True), (2, "Home > Kitchen", True), (3, "Shop All", True), (4, "Scotch-Brite Non-Scratch 1pk", False), (5, "Paper Towels114 PRODUCTS", True), (6, "Cleaning Tools (147)", True), (7, "", False), (8, "SKYN 3pk", False)]


@query("q_category_names", expect([(i, str(ok).lower()) for i, _, ok in _NAMES], ["ord", "is_category"], longs=("ord",)).replace("is_category FROM", "is_category = 'true' AS is_category FROM"))
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([x[:2] for x in _NAMES], "ord long, name string").select("ord", text.is_category_name(F.col("name")).alias("is_category"))


@query("q_absolute_urls", "SELECT p_partkey AS ord, concat('https://shop.example/a/p/', CAST(p_partkey AS VARCHAR)) AS absolute FROM part")
def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("../a/p/"), F.col("p_partkey").cast("string"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), url.absolute_url(href, F.lit("https://shop.example/x/list")).alias("absolute"))


DETAILS = [
    (1, "https://d.example/p/one", '<body><nav><a href="/p/menu">Menu</a></nav><h1>Blue Soap</h1><dl><dt>Item No:</dt><dd>BS-16</dd><dt>Case Pack</dt><dd>12</dd><dt>UPC</dt><dd>0-12345-67890-5</dd></dl><p>$3.75</p><img src="/i/b.jpg"><table><tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table></body>'),
    (2, "https://d.example/p/two", '<head><meta itemprop="gtin13" content="4006381333931"><script>var p = {"productID":"012345678905"}</script></head><body><h1>Red Soap</h1><span>Unit Price: $2.00</span></body>'),
    (3, "https://d.example/p/three", '<body><script>window.x = {productID: "012345678905"};</script><h1>Green</h1></body>'),
    (4, "https://d.example/list", '<body><div class="grid"><div class="product-card"><a href="/product/tea-box"><img src="/t.jpg" alt="Tea"></a><h3>Tea Box</h3><b>$4.00</b></div><div class="product-card"><a href="/product/cup">Cup</a><b>$1.00</b></div><div class="product-card"><a href="/collections/all">View all</a></div></div><a href="https://else.example/product/x">x</a></body>'),
]


def _details(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    p = spark.createDataFrame(DETAILS, "page_id long, url string, html string")
    return p, dom.nodes(p)


@query("q_detail_identifiers", expect([(1, "012345678905", "label"), (2, "4006381333931", "meta"), (3, "012345678905", "script")], ["page_id", "upc", "evidence"]))
def detail_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.identifiers(*_details(spark)).select("page_id", "upc", "evidence")


_DROWS = [(4, "", "", "", "$4.00", "", "https://d.example/t.jpg"), (1, "Blue Soap", "BS-16", "012345678905", "$3.75", "12", "https://d.example/i/b.jpg"), (2, "Red Soap", "", "4006381333931", "$2.00", "", ""), (3, "Green", "", "012345678905", "", "", "")]


@query("q_detail_rows", expect(_DROWS, ["page_id", "product_name", "sku", "upc", "price", "case_pack", "image_url"]))
def detail_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.detail_rows(*_details(spark)).select("page_id", "product_name", "sku", "upc", "price", "case_pack", "image_url")


@query("q_rich_detail", expect([(1, 8), (2, 1), (3, 0), (4, 0)], ["page_id", "score"], ints=("score",)))
def rich_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.rich_detail(_details(spark)[1]).select("page_id", "score")


@query("q_scored_links", expect([(1, "https://d.example/p/menu", 5), (4, "https://d.example/product/tea-box", 9), (4, "https://d.example/product/cup", 6), (4, "https://d.example/collections/all", -6)], ["page_id", "href", "score"], ints=("score",)))
def scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.scored_links(*_details(spark)).select("page_id", "href", "score")


@query("q_best_links", expect([(1, "https://d.example/p/menu", 5), (4, "https://d.example/product/tea-box", 9)], ["page_id", "href", "score"], ints=("score",)))
def best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.best_links(detail_ops.scored_links(*_details(spark)))


@query("q_cards", expect([(4, "Tea Box", "$4.00", "https://d.example/t.jpg", "https://d.example/product/tea-box"), (4, "Cup", "$1.00", "", "https://d.example/product/cup")], ["page_id", "product_name", "price", "image_url", "product_url"]))
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_ops.cards(*_details(spark)).where("looks_like_product").select("page_id", "product_name", "price", "image_url", "product_url")


# The same operators over whole tables, without SQL: `pages` as it stands, feeds, payloads, texts and titles from all of `part`.
def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = load(spark, sf_dir, "pages")
    return p, dom.nodes(p)


def _select(spark: SparkSession, rows: DataFrame, columns: str) -> DataFrame:
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=rows)


def _classified(p: DataFrame, n: DataFrame) -> DataFrame:
    return page_ops.classify(page_ops.features(p, n, structured.jsonld(p, n)))


_OVER_PAGES = {
    "q_all_jsonld": lambda p, n: structured.jsonld(p, n).select(_S),
    "q_all_microdata": lambda p, n: structured.microdata(p, n).select(_S),
    "q_all_opengraph": lambda p, n: structured.open_graph(p, n).select(_S),
    "q_all_structured_tiers": lambda p, n: structured.structured(p, n).select(_S),
    "q_all_table_rows": lambda p, n: page_ops.table_rows(n).select("page_id", "sku", "product_name", "qty", "price", "case_pack"),
    "q_all_page_classes": _classified,
    "q_all_needs_browser": lambda p, n: page_ops.needs_browser(page_ops.features(p, n)),
    "q_all_page_numbers": lambda p, n: dom.highest_page_button(n).join(dom.next_links(n), "page_id", "full").select("page_id", "highest", "next_href", "tier"),
    "q_all_detail_identifiers": lambda p, n: detail_ops.identifiers(p, n).select("page_id", "upc", "evidence"),
    "q_all_detail_rows": lambda p, n: detail_ops.detail_rows(p, n).select("page_id", "product_name", "sku", "upc", "price", "case_pack", "image_url"),
    "q_all_rich_detail": lambda p, n: detail_ops.rich_detail(n).select("page_id", "score"),
    "q_all_scored_links": lambda p, n: detail_ops.scored_links(p, n).select("page_id", "href", "score"),
    "q_all_best_links": lambda p, n: detail_ops.best_links(detail_ops.scored_links(p, n)),
    "q_all_cards": lambda p, n: detail_ops.cards(p, n).where("looks_like_product").select("page_id", "product_name", "price", "image_url", "product_url"),
    "q_all_product_urls": lambda p, n: dom.links(n).select("page_id", "href").join(p.select("page_id", "url"), "page_id").select("page_id", url.absolute_url("href", "url").alias("url")).select("page_id", "url", url.is_product_url(F.col("url")).alias("is_product")),
}
_SITE = "'https://s.example'"
_OBJECT = "p_partkey AS id, p_name AS name, p_name AS title, p_brand AS vendor, p_brand AS brand, concat('SKU-', p_partkey) AS sku, concat('/product/', p_partkey) AS url"
_FROM_PART = {
    "q_all_feed_variants": (f"p_partkey AS ord, {_SITE} AS root, to_json(struct(p_partkey AS id, p_name AS title, p_brand AS vendor, concat('h', p_partkey) AS handle, array(struct(p_partkey AS id, concat('SKU-', p_partkey) AS sku, cast(p_size AS string) AS price, true AS available), struct(-p_partkey AS id, '' AS sku, '' AS price, false AS available)) AS variants)) AS body", lambda d: feeds.variant_rows(d).select(_FA)),
    "q_all_feed_attributes": (f"p_partkey AS ord, {_SITE} AS root, to_json(struct(p_partkey AS id, p_name AS name, concat('s', p_partkey) AS slug, concat('SKU-', p_partkey) AS sku, array(struct('Brand' AS name, array(struct(p_brand AS name)) AS terms)) AS attributes)) AS body", lambda d: feeds.attribute_rows(d).select(_FB)),
    "q_all_payload_walk": (f"p_partkey AS page_id, {_SITE} AS url, to_json(struct(array(struct({_OBJECT})) AS products, array(struct(p_size AS id, '/i/x.jpg' AS url)) AS media)) AS body", lambda d: payloads.walk_payloads(d).select(_S)),
    "q_all_markdown_cards": (f"p_partkey AS page_id, {_SITE} AS url, concat('1. [![', p_name, '](/i/', p_size, '.jpg)](/item-', p_partkey, ')\\n$', p_size, '.50\\n') AS body", lambda d: payloads.markdown_cards(d).select(_MD)),
    "q_all_link_rows": (f"p_partkey AS page_id, {_SITE} AS url, array(concat('/product/', p_partkey), concat('/product/', p_partkey, '#top'), '/about') AS links", lambda d: payloads.link_rows(d).select("page_id", "product_name", "product_url")),
    "q_all_model_rows": (f"p_partkey AS page_id, {_SITE} AS url, to_json(struct(array(struct({_OBJECT})) AS products)) AS body", lambda d: payloads.model_rows(d).select(_S)),
    "q_all_strengthen": ("p_partkey AS ord, concat(p_name, ' ', p_size, ' ct') AS title", lambda d: d.select("ord", text.title_brand(F.col("title")).alias("brand"), text.case_count(F.col("title")).alias("case_count"), text.clean_title(F.col("title")).alias("clean"))),
    "q_all_category_names": ("p_partkey AS ord, p_type AS name", lambda d: d.select("ord", text.is_category_name(F.col("name")).alias("is_category"))),
}
for _name, _plan in _OVER_PAGES.items():
    query(_name)(lambda spark, sf_dir, plan=_plan: plan(*_whole(spark, sf_dir)))
for _name, (_columns, _plan) in _FROM_PART.items():
    query(_name)(lambda spark, sf_dir, columns=_columns, plan=_plan: plan(_select(spark, dealt(load(spark, sf_dir, "part"), "p_partkey"), columns)))
