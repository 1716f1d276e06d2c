"""Queries of the page, feed and payload operators over inputs made from every row of `part`.

Each part gives one page, feed product or payload by an SQL text; the counterpart states what the operator must find in it,
by the columns of the part and not by the operator. Several forms of markup take turns by the part's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, money, scoring, text, url
from ..operators import cards, crawl, detail, detail_page, enrichment, evidence, layouts, merge, pages, payloads, structured, targets
from ..sources import feeds
from ..sources import nodes as dom
from .base import dealt, load
from .queries import query

SITE, LIST = "https://s.example", "https://s.example/list"
#: k, n, b, z: key, name, brand and size of a part.
PART = "(SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size AS z FROM part)"
_COLUMNS = ["p_partkey AS k", "p_name AS n", "p_brand AS b", "p_size AS z"]
#: Four GTINs with valid check digits, by the key.
CODE = "CASE k % 4 WHEN 0 THEN '012345678905' WHEN 1 THEN '4006381333931' WHEN 2 THEN '12345670' ELSE '00012345600012' END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(load(spark, sf_dir, "part").selectExpr(*_COLUMNS), "k")


def of(template: str) -> str:
    """An SQL text of a template with expressions in [[...]]."""
    out = []
    for i, piece in enumerate(template.replace("]]", "[[").split("[[")):
        out.append(f"cast({piece} AS string)" if i % 2 else "'" + piece.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"concat({', '.join(out)})"


def forms(*templates: str, by: str = "k") -> str:
    """The templates in turn."""
    whens = " ".join(f"WHEN {i} THEN {of(t)}" for i, t in enumerate(templates))
    return f"CASE {by} % {len(templates)} {whens} END"


def over(name: str, expected: str | None, html: str, plan: Callable[[DataFrame], DataFrame], address: str = f"'{LIST}'") -> None:
    """Register a query of one page for each part; FROM part in `expected` has k, n, b and z."""

    @query(name, expected.replace("FROM part", f"FROM {PART} part") if expected else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(parts(spark, sf_dir).selectExpr("k AS page_id", f"{address} AS url", f"{html} AS html"))


def simple(name: str, expected: str, *columns) -> None:
    """Register a query of column expressions over part."""

    @query(name, expected.replace("FROM part", f"FROM {PART} part"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parts(spark, sf_dir).select("k", *(c() if callable(c) else c for c in columns))


# --- structured data -----------------------------------------------------------------------------------------------
_LD = of(
    '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":"Product","name":"[[n]]","sku":"S-[[k]]","brand":{"name":"[[b]]"},"gtin13":"[[lpad(k, 13, \'4\')]]",'
    '"image":["/i/[[k]].jpg"],"url":"/p/[[k]]","offers":{"price":"[[z]].50","priceCurrency":"USD"}}},{"item":{"@type":["Thing","Product"],"name":"[[n]] two","mpn":"M-[[k]]","brand":"[[b]]","offers":[{"price":[[z]],"priceCurrency":"CAD","url":"/p/two"}]}}]}</script>'
    '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"[[n]] three","productID":"[[lpad(k, 12, \'3\')]]"}]}</script><script type="application/ld+json">{broken</script>'
)
_S = ["page_id", "product_name", "brand", "sku", "upc", "price", "image_url", "product_url"]
_LD_ONE = f"SELECT k AS page_id, n AS product_name, b AS brand, concat('S-', k) AS sku, lpad(CAST(k AS VARCHAR), 13, '4') AS upc, concat('$', z, '.50') AS price, concat('{SITE}/i/', k, '.jpg') AS image_url, concat('{SITE}/p/', k) AS product_url FROM part"
_LD_TWO = f"SELECT k, concat(n, ' two'), b, concat('M-', k), '', concat(z, ' CAD'), '', '{SITE}/p/two' FROM part"
_LD_THREE = "SELECT k AS page_id, concat(n, ' three') AS product_name, '' AS brand, '' AS sku, {upc} AS upc, '' AS price, '' AS image_url, '' AS product_url FROM part"
over("q_part_jsonld", " UNION ALL ".join([_LD_ONE, _LD_TWO, _LD_THREE.format(upc="lpad(CAST(k AS VARCHAR), 12, '3')")]), _LD, lambda p: structured.jsonld(p, dom.nodes(p)).select(_S))
over("q_part_jsonld_flat", _LD_THREE.format(upc="''"), _LD, lambda p: structured.jsonld(p, dom.nodes(p), nested=False).select(_S))

_MICRO = of(
    '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">[[n]]</span><span itemprop="brand">[[b]]</span><meta itemprop="sku" content="S-[[k]]"><meta itemprop="gtin12" content="[[lpad(k, 12, \'4\')]]">'
    '<img itemprop="image" src="/i/[[k]].jpg"><a itemprop="url" href="/p/[[k]]">x</a><div itemprop="offers" itemscope><span itemprop="price">[[z]].25</span><meta itemprop="priceCurrency" content="USD"></div></div>'
)
_OG = of('<meta property="og:type" content="product"><meta property="og:title" content="[[n]]"><meta property="product:price:amount" content="[[z]].75"><meta property="product:price:currency" content="EUR"><meta property="product:brand" content="[[b]]"><meta property="og:image" content="/i/[[k]].jpg">')
_MICRO_ROW = f"SELECT k AS page_id, n AS product_name, b AS brand, concat('S-', k) AS sku, lpad(CAST(k AS VARCHAR), 12, '4') AS upc, concat('$', z, '.25') AS price, concat('{SITE}/i/', k, '.jpg') AS image_url, concat('{SITE}/p/', k) AS product_url FROM part"
_OG_ROW = f"SELECT k AS page_id, n AS product_name, b AS brand, '' AS sku, '' AS upc, concat(z, '.75 EUR') AS price, concat('{SITE}/i/', k, '.jpg') AS image_url, '{LIST}' AS product_url FROM part"
over("q_part_microdata", _MICRO_ROW, _MICRO, lambda p: structured.microdata(p, dom.nodes(p)).select(_S))
over("q_part_opengraph", _OG_ROW, _OG, lambda p: structured.open_graph(p, dom.nodes(p)).select(_S))
over(
    "q_part_structured_tiers", f"SELECT * FROM ({_MICRO_ROW}) WHERE page_id % 2 = 0 UNION ALL SELECT * FROM ({_OG_ROW}) WHERE page_id % 2 = 1",
    f"CASE WHEN k % 2 = 0 THEN concat({_OG}, {_MICRO}) ELSE {_OG} END", lambda p: structured.structured(p, dom.nodes(p)).select(_S),
)

# --- labelled rows -------------------------------------------------------------------------------------------------
_TABLE = of(
    "<table><thead><tr><th>Image</th><th>Item No</th><th>Description</th><th>Unit Price</th><th>Case Pack</th><th>Order</th><th>UPC</th></tr></thead><tbody>"
    '<tr><td><img src="/s.png" width="2" height="2"><img src="/i/[[k]].png" width="40" height="30"></td><td>T-[[k]]</td><td>[[n]] <b>big</b></td><td>1+ $[[z]].50 10+ $[[z]].25</td><td>12</td><td><a href="/cart">x</a><a href="/p/[[k]]">Go</a></td><td>[[lpad(k, 12, \'2\')]]</td></tr>'
    '<tr><td></td><td><a href="/d/[[k]]">U-[[k]]</a></td><td>[[n]] small</td><td>$[[z]].00</td><td>6</td><td></td><td>none</td></tr></tbody></table>'
)
_GRID = of(
    "<section><div><span>Photo</span><span>Product Name</span><span>Price</span><span>Quick Order</span><span>Qty</span></div>"
    "<div><span><i style=\"background-image:url('/b/[[k]].png')\"></i></span><span>[[n]]</span><span>call us</span><span>Order [[100000 + k]] now</span><span>[[z]]</span></div>"
    '<div><span><a href="/p/[[k]]"><img data-src="/c/[[k]].png"></a></span><span>[[n]] two</span><span>$[[z]].75</span><span></span><span>[[z]]</span></div></section>'
)
_LAYOUT = ["page_id", "layout", "product_name", "sku", "price", "raw_price_text", "case_pack", "upc", "pack_size", "image_url", "product_url"]
over(
    "q_part_layout_rows",
    f"""SELECT k AS page_id, 'table' AS layout, concat(n, ' big') AS product_name, concat('T-', k) AS sku, concat('$', z, '.25') AS price, concat('1+ $', z, '.50 10+ $', z, '.25') AS raw_price_text, '12' AS case_pack, lpad(CAST(k AS VARCHAR), 12, '2') AS upc, '' AS pack_size,
        concat('{SITE}/i/', k, '.png') AS image_url, '{SITE}/cart' AS product_url FROM part WHERE k % 2 = 0
    UNION ALL SELECT k, 'table', concat(n, ' small'), concat('U-', k), concat('$', z, '.00'), '', '6', '', '', '', concat('{SITE}/d/', k) FROM part WHERE k % 2 = 0
    UNION ALL SELECT k, 'div_grid', n, CAST(100000 + k AS VARCHAR), 'call us', '', '', '', CAST(z AS VARCHAR), concat('{SITE}/b/', k, '.png'), '' FROM part WHERE k % 2 = 1
    UNION ALL SELECT k, 'div_grid', concat(n, ' two'), '', concat('$', z, '.75'), '', '', '', CAST(z AS VARCHAR), concat('{SITE}/c/', k, '.png'), concat('{SITE}/p/', k) FROM part WHERE k % 2 = 1""",
    f"CASE WHEN k % 2 = 0 THEN {_TABLE} ELSE {_GRID} END", lambda p: layouts.layout_rows(p).select(_LAYOUT),
)
over(
    "q_part_row_links",
    f"""SELECT k AS page_id, '{SITE}/cart' AS product_url, concat('{SITE}/p/', k) AS alternatives FROM part WHERE k % 2 = 0 UNION ALL SELECT k, concat('{SITE}/d/', k), '' FROM part WHERE k % 2 = 0
    UNION ALL SELECT k, concat('{SITE}/p/', k), '' FROM part WHERE k % 2 = 1""",
    f"CASE WHEN k % 2 = 0 THEN {_TABLE} ELSE {_GRID} END", lambda p: layouts.row_links(p).select("page_id", "product_url", F.array_join("alternatives", " ").alias("alternatives")),
)
over(
    "q_part_table_rows",
    "SELECT k AS page_id, concat('T-', k) AS sku, concat(n, ' big') AS product_name, concat('1+ $', z, '.50 10+ $', z, '.25') AS price, '12' AS case_pack, lpad(CAST(k AS VARCHAR), 12, '2') AS upc FROM part UNION ALL SELECT k, concat('U-', k), concat(n, ' small'), concat('$', z, '.00'), '6', 'none' FROM part",
    _TABLE, lambda p: pages.table_rows(dom.nodes(p)).select("page_id", "sku", "product_name", "price", "case_pack", "upc"),
)
over(
    "q_part_order_table",
    f"""SELECT k AS page_id, concat('Blue ', n) AS product_name, concat('ORD-', k) AS sku, concat('$', z, '.40') AS price, 'EA' AS pack_size, '144 EA' AS case_pack, concat('{SITE}/i/', k, '.jpg') AS image_url, concat('{SITE}/product/x-', k) AS product_url, 'Towels' AS category FROM part
    UNION ALL SELECT k, n, concat('Z', 1000 + k), concat('$', z), '', '', '', '', '' FROM part""",
    of(
        '<table class="product-table"><tr><td>Order</td><td>Image</td><td>Description</td><td>Qty</td></tr><tr><td>Order code ORD-[[k]]</td><td><a href="/product/x-[[k]]"><img src="/i/[[k]].jpg"></a></td><td><a href="/c/towels">Towels</a> Blue [[n]]</td><td>EA / 144.0 EA+</td><td><span class="ext-price">$[[z]].40</span></td></tr>'
        '<tr><td>Z[[1000 + k]]</td><td></td><td>[[n]]</td><td>$ [[z]] each</td></tr><tr><th>x</th><td>a</td><td>b</td></tr></table><table class="plain"><tr><td>price</td><td>2</td><td>3</td></tr></table>'
    ),
    lambda p: layouts.order_tables(p).select("page_id", "product_name", "sku", "price", "pack_size", "case_pack", "image_url", "product_url", "category"),
)

# --- cards ---------------------------------------------------------------------------------------------------------
_CARDS = of(
    '<title>[[n]]</title><div class="menu-item"><div class="product-card"><a href="/p/menu">menu of the whole wide shop</a></div></div>'
    '<div class="product-card"><img src="/i/[[k]]a.jpg"><h3>[[n]] one</h3><span class="price">$[[z]].00</span><a href="/p/[[k]]-one">see it</a><p>in stock now</p></div>'
    '<div class="product-card" data-sku="b[[k]]"><span class="product-title">[[n]] two</span><img data-src="/i/[[k]]b.jpg"><s class="price was">$99.00</s><span class="price sale">$[[z]].50</span><a href="/p/[[k]]-two">show it</a></div>'
    '<div class="product-card"><img src="data:x" data-original="/i/[[k]]c.jpg"><a href="/p/[[k]]-three">[[n]] three pieces</a><b>$[[z]].25</b><i class="unit">bx</i><u>SKU# AB-[[k]]</u><em class="vendor">[[b]]</em></div>'
)
_C = ["page_id", "product_name", "brand", "sku", "price", "strict_price", "image_url", "product_url"]
over(
    "q_part_cards",
    f"""SELECT k AS page_id, concat(n, ' one') AS product_name, '' AS brand, '' AS sku, concat('$', z, '.00') AS price, concat('$', z, '.00') AS strict_price, concat('{SITE}/i/', k, 'a.jpg') AS image_url, concat('{SITE}/p/', k, '-one') AS product_url FROM part
    UNION ALL SELECT k, concat(n, ' two'), '', concat('B', k), concat('$', z, '.50'), '$99.00', concat('{SITE}/i/', k, 'b.jpg'), concat('{SITE}/p/', k, '-two') FROM part
    UNION ALL SELECT k, concat(n, ' three pieces'), b, concat('AB-', k), concat('$', z, '.25/BX'), '', concat('{SITE}/i/', k, 'c.jpg'), concat('{SITE}/p/', k, '-three') FROM part""",
    _CARDS, lambda p: cards.listing_cards(p).select(_C),
)
over(
    "q_part_rendered_cards",
    f"""SELECT k AS page_id, n AS product_name, b AS brand, concat('$', z, '.50 CS') AS price, CAST(7000000 + k AS VARCHAR) AS sku, concat(z, ' OZ') AS pack_size, '12' AS case_pack, concat('{SITE}/i/', k, '.png') AS image_url, concat('{SITE}/p/', k) AS product_url FROM part WHERE k % 2 = 0
    UNION ALL SELECT k, n, '', concat('$', z, '.5'), concat('Q-', k), '', '', '', concat('{SITE}/p/', k) FROM part WHERE k % 2 = 1""",
    forms(
        '<h2>[[n]]</h2><span class="vendor">[[b]]</span><div class="box"><span class="sale-price">$[[z]].50</span><span>CS</span><span>$99.00</span></div><span class="supc">[[7000000 + k]]</span><span class="pack-size">[[z]] OZ</span><dl><dt>Case-Pack:</dt><dd>12</dd></dl><img data-src="/i/[[k]].png"><a href="#">t</a><a href="/p/[[k]]">x</a>',
        '<a aria-label="[[n]]" href="/p/[[k]]"></a><p data-sku="product-card-1">now $[[z]].5 only</p><p>Item #: Q-[[k]]</p>',
    ),
    lambda p: cards.rendered_cards(p),
)
over(
    "q_part_page_intent",
    "SELECT k AS page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(n, '[a-z0-9]{4,}'), ['brand', 'example', 'list']))), ' ') AS terms FROM part",
    of("<title>[[n]]</title><h1>The products of [[b]]</h1><p>unrelated</p>"), lambda p: cards.page_intent(p).select("page_id", F.array_join("terms", " ").alias("terms")),
)

# --- links ---------------------------------------------------------------------------------------------------------
_TILE = '<div class="tile"><a href="/product/[[k]]{i}"><img src="/a.png"></a><a href="/cart/add">add to cart</a><button onclick="location.href=\'/item/x-[[k]]-{i}\'">details</button><span data-url="/pd/x-[[k]]-{i}">SKU price qty order unit</span></div>'
_TILES = of('<nav><div class="tile"><a href="/product/nav">n</a></div></nav>' + "".join(_TILE.format(i=i) for i in (0, 1)))
_AT = lambda i: f"SELECT k AS page_id, CAST(1 AS INT) AS rank, concat('{SITE}/pd/x-', k, '-{i}') AS url, 'data-url' AS source, CAST(12 AS INT) AS score FROM part UNION ALL SELECT k, 2, concat('{SITE}/item/x-', k, '-{i}'), 'onclick_url', 10 FROM part UNION ALL SELECT k, 3, concat('{SITE}/product/', k, '{i}'), 'href', 9 FROM part"
over("q_part_targets", f"{_AT(0)} UNION ALL {_AT(1)}", _TILES, lambda p: targets.best_targets(targets.page_targets(p), ["page_id", "container"]).select("page_id", "rank", "url", "source", F.col("score").cast("int").alias("score")))
over(
    "q_part_product_links",
    f"""SELECT k AS page_id, CAST(-1 AS INT) AS pass, concat('{SITE}/r/', k) AS product_url FROM part WHERE k % 4 = 0 UNION ALL SELECT k, -1, concat('{SITE}/r/', k, 'b') FROM part WHERE k % 4 = 0
    UNION ALL SELECT k, 0, concat('{SITE}/pd/x-', k, '-', i) FROM part, (VALUES (0), (1)) t(i) WHERE k % 4 = 1 UNION ALL SELECT k, 1, concat('{SITE}/products/', k) FROM part WHERE k % 4 = 2 UNION ALL SELECT k, 3, concat('{SITE}/zz/', k, '-abc') FROM part WHERE k % 4 = 3""",
    forms(
        '<table><tr><th>Item No</th><th>Description</th><th>Price</th></tr><tr><td><a href="/r/[[k]]">I1</a></td><td>a</td><td>$1.00</td></tr><tr><td><a href="/r/[[k]]b">I2</a></td><td>b</td><td>$2.00</td></tr></table>', "".join(_TILE.format(i=i) for i in (0, 1)),
        '<header><img src="/x.png"><a href="/products/none">x</a></header><ul><li><img src="/y.png"><a href="/products/[[k]]">y</a><a href="/blog/products/1">no</a><a href="https://else.example/products/1">no</a></li></ul>', '<div><img src="/z.png"><a href="/zz/[[k]]-abc">z</a><a href="/search?q=1">no</a></div>',
    ),
    lambda p: targets.product_links(p).select("page_id", "pass", "product_url"),
)


@query("q_part_first_rich", f"SELECT k, CASE WHEN k % 6 >= 4 OR k % 6 >= k % 9 AND k % 9 < 4 THEN concat('a', k) ELSE concat('b', k) END AS url, CAST(CASE WHEN k % 6 >= 4 OR k % 6 >= k % 9 AND k % 9 < 4 THEN k % 6 ELSE k % 9 END AS INT) AS page_score, k % 6 >= 4 OR k % 9 >= 4 AS is_rich FROM {PART} part")
def first_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    tried = p.selectExpr("k", "explode(array(struct(1 AS rank, concat('a', k) AS url), struct(2 AS rank, concat('b', k) AS url), struct(3 AS rank, concat('c', k) AS url))) AS t").select("k", "t.rank", "t.url")
    judged = p.selectExpr("explode(array(struct(concat('a', k) AS url, cast(k % 6 AS int) AS score), struct(concat('b', k) AS url, cast(k % 9 AS int) AS score))) AS t").select("t.url", "t.score")
    return targets.first_rich(tried, judged, ["k"])


over(
    "q_part_best_links", f"SELECT k AS page_id, concat('{SITE}/product/xx-', k) AS href, CAST(9 AS INT) AS score FROM part",
    of('<nav><a href="/about">About</a></nav><div class="card"><a href="/collections/all">View all</a><a href="/p/x-[[k]]">p</a><a href="/product/xx-[[k]]"><img src="/a.png"></a></div>'),
    lambda p: detail.best_links(detail.scored_links(p, dom.nodes(p))).select("page_id", "href", F.col("score").cast("int").alias("score")),
)

# --- detail pages --------------------------------------------------------------------------------------------------
_DETAIL = forms(
    '<script type="application/ld+json">[{"@type":"Product","name":"[[n]]","brand":{"name":"[[b]]"},"sku":"L-[[k]]","gtin13":"[[lpad(k, 13, \'4\')]]","image":["","/i/[[k]].jpg"],"offers":[null,{"price":"[[z]].50"}]}]</script><h1>other</h1>',
    '<meta property="og:title" content="[[n]] 12oz/6pk"><meta itemprop="brand" content="[[b]]"><meta itemprop="sku" content="M-[[k]]"><meta itemprop="price" content="[[z]].75"><meta name="upc" content="[[lpad(k, 12, \'8\')]]"><meta property="og:image" content="/m.jpg"><p data-moq="5"></p>',
    '<h1>[[n]]  12oz/6pk | Nassau Candy</h1><dl><dt>Item-No:</dt><dd>D-[[k]]</dd><dt>UPC:</dt><dd>0 [[lpad(k, 11, \'7\')]]</dd><dt>Case Pack</dt><dd>24</dd><dt>Minimum Order</dt><dd>3</dd><dt>Bulk Price</dt><dd>$9.99 case</dd><dt>GTIN Case</dt><dd>1 [[lpad(k, 13, \'6\')]]</dd></dl>'
    '<span class="brand">[[b]]</span><p class="price">$[[z]].25 / Each</p><img src="/i/[[k]].png">',
    '<h1>[[n]]</h1><script>var vm = {BMupc: "[[lpad(k, 12, \'6\')]]", other: "x"};</script><script type="application/json">{"price": "[[z]].10", "casePack": "48"}</script><i>SKU [[1000 + k]]</i><p>Net Weight: [[z]] OZ</p>',
)
_DETAIL_COLUMNS = ["product_name", "brand", "sku", "upc", "price", "unit_price", "pricing_unit", "unit_size", "case_pack", "bulk_price", "minimum_order_qty", "raw_price_text", "image_url", "gtin_case", "ean", "identifier_type", "identifier_source"]
_DETAIL_ROWS = [
    ["n", "b", "concat('L-', k)", "lpad(CAST(k AS VARCHAR), 13, '4')", "concat(z, '.50')", "''", "''", "''", "''", "''", "''", "''", "concat('/i/', k, '.jpg')", "''", "lpad(CAST(k AS VARCHAR), 13, '4')", "'ean13'", "'json_ld'"],
    ["concat(n, ' 12oz/6pk')", "b", "concat('M-', k)", "lpad(CAST(k AS VARCHAR), 12, '8')", "concat('$', z, '.75')", "''", "''", "'12 OZ'", "'6'", "''", "'5'", "''", "'/m.jpg'", "''", "''", "'upc'", "'meta'"],
    ["concat(n, ' 12oz/6pk')", "b", "concat('D-', k)", "concat('0', lpad(CAST(k AS VARCHAR), 11, '7'))", "concat('$', z, '.25')", "concat('$', z, '.25')", "'EACH'", "'12 OZ'", "'24'", "'$9.99'", "'3'", "concat('$', z, '.25 / Each')", f"concat('{SITE}/i/', k, '.png')", "concat('1', lpad(CAST(k AS VARCHAR), 13, '6'))", "''", "'upc'", "'label'"],
    ["n", "''", "CAST(1000 + k AS VARCHAR)", "lpad(CAST(k AS VARCHAR), 12, '6')", "concat(z, '.10')", "''", "''", "concat(z, ' OZ')", "'48'", "''", "''", "''", "''", "''", "''", "'upc'", "'script'"],
]
over(
    "q_part_detail_fields", " UNION ALL ".join(f"SELECT k AS page_id, {', '.join(f'{e} AS {c}' for e, c in zip(row, _DETAIL_COLUMNS, strict=True))} FROM part WHERE k % 4 = {i}" for i, row in enumerate(_DETAIL_ROWS)),
    _DETAIL, lambda p: detail_page.detail_fields(p).select("page_id", *_DETAIL_COLUMNS),
)
_EVIDENCE = forms(
    f'<script type="application/ld+json">{{"gtin14":"1","gtin13":"[[{CODE}]]"}}</script>', f'<meta name="product:upc" content="[[{CODE}]]">', f"<ul><li>UPC no. [[{CODE}]]</li></ul>", f"<script>var x = {{barcode: '[[{CODE}]]'}}; var y = {{upc: '123456789012'}};</script>", by="k",
)
_EVIDENCE_SQL = f"SELECT k AS page_id, {CODE} AS identifier, CASE k % 4 WHEN 0 THEN 'gtin13' WHEN 1 THEN 'product:upc' WHEN 2 THEN 'visible_label' ELSE 'barcode' END AS identifier_type, CASE k % 4 WHEN 0 THEN 'jsonld:gtin13' WHEN 1 THEN 'meta:product:upc' WHEN 2 THEN 'visible_label' ELSE 'script_identifier_field' END AS source FROM part"
over("q_part_identifier_evidence", _EVIDENCE_SQL, _EVIDENCE, detail_page.identifier_evidence)


@query(
    "q_part_assign_identifier",
    f"""SELECT k, CASE WHEN k % 3 = 0 THEN '999' WHEN k % 2 = 0 THEN code ELSE '' END AS upc, CASE WHEN k % 3 <> 0 AND k % 2 = 0 AND length(code) IN (8, 13) THEN code ELSE '' END AS ean, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'script' ELSE '' END AS upc_source FROM (SELECT k, {CODE} AS code FROM {PART} part)""",
)
def assign_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    products = p.selectExpr("k", "concat('u', k) AS product_url", "CASE WHEN k % 3 = 0 THEN '999' ELSE '' END AS upc", "'' AS ean", "'' AS gtin")
    found = p.where("k % 2 = 0").selectExpr("concat('u', k) AS product_url", f"{CODE} AS identifier", "'script' AS source")
    return enrichment.assign_identifier(products, found).select("k", "upc", "ean", "upc_source")


over("q_part_identifiers", "SELECT k AS page_id, lpad(CAST(k AS VARCHAR), 12, '1') AS upc, CASE k % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'label' ELSE 'script' END AS evidence FROM part", forms('<meta itemprop="gtin12" content="[[lpad(k, 12, \'1\')]]"><b>UPC: 0</b>', "<dl><dt>Barcode</dt><dd>[[lpad(k, 12, '1')]]</dd></dl>", "<script>var p = {gtin: '[[lpad(k, 12, '1')]]'}</script>"), lambda p: detail.identifiers(p, dom.nodes(p)).select("page_id", "upc", "evidence"))
over(
    "q_part_detail_rows", f"SELECT k AS page_id, n AS product_name, concat('X-', k) AS sku, concat('$', z, '.00') AS price, '12' AS case_pack, concat('{SITE}/i/', k, '.jpg') AS image_url, '{LIST}' AS product_url FROM part",
    of('<nav><h1>menu</h1></nav><h1>[[n]]</h1><dl><dt>Item No:</dt><dd>X-[[k]]</dd><dt>Case Pack</dt><dd>12</dd></dl><p>$[[z]].00</p><img src="/i/[[k]].jpg">'),
    lambda p: detail.detail_rows(p, dom.nodes(p)).select("page_id", "product_name", "sku", "price", "case_pack", "image_url", "product_url"),
)
over(
    "q_part_rich_detail", "SELECT k AS page_id, CAST(CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 1 ELSE 0 END AS INT) AS score, k % 3 = 0 AS is_rich FROM part",
    forms('<script type="application/ld+json">{"@type":"Product"}</script><p>case pack 123456789</p>', "<table><tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>", "<p>[[n]]</p><table><tr><td>a</td></tr></table><dt>one</dt>"),
    lambda p: detail.rich_detail(dom.nodes(p)).select("page_id", F.col("score").cast("int").alias("score"), "is_rich"),
)

# --- page classes and predicates -----------------------------------------------------------------------------------
_WORDS = "words " * 120
_KINDS = forms(
    '<body><form action="/signin"><input type="password"></form></body>', '<body><div id="root"></div><script>window.__NEXT_DATA__ = {}</script></body>', f'<body><h1>[[n]]</h1><span class="price">$[[z]].00</span><p>{_WORDS}</p></body>',
    f'<body><div class="grid">{"".join(f"""<div class="product-card"><a href="/p/{i}">c</a><span class="price">$1.00</span></div>""" for i in range(5))}</div><p>{_WORDS}</p></body>',
    f'<body><script type="application/ld+json">{{"@type":"Product","name":"[[n]]"}}</script><p>{_WORDS}</p></body>', f'<body><table class="price-list"><tr><td>a</td><td>$1</td></tr><tr><td>b</td><td>$2</td></tr><tr><td>c</td><td>$3</td></tr></table><p>{_WORDS}</p></body>', f"<body><p>{_WORDS}</p><p>Access Denied [[n]]</p></body>",
)


def _features(p: DataFrame) -> DataFrame:
    n = dom.nodes(p)
    return pages.features(p, n, structured.jsonld(p, n))


over(
    "q_part_page_classes",
    """SELECT k AS page_id, CASE k % 7 WHEN 0 THEN 'login_required' WHEN 1 THEN 'js_app' WHEN 2 THEN 'detail_page' WHEN 3 THEN 'listing_grid' WHEN 4 THEN 'detail_page' WHEN 5 THEN 'row_catalog' ELSE 'listing_grid' END AS page_type,
        CAST(CASE k % 7 WHEN 0 THEN 0.99 WHEN 1 THEN 0.9 WHEN 2 THEN 0.65 WHEN 3 THEN 0.6 WHEN 4 THEN 0.95 WHEN 5 THEN 0.62 ELSE 0.35 END AS DOUBLE) AS confidence FROM part""",
    _KINDS, lambda p: pages.classify(_features(p)),
)
over("q_part_needs_browser", "SELECT k AS page_id, k % 7 IN (0, 1, 6) AS needs_browser FROM part", _KINDS, lambda p: pages.needs_browser(_features(p)))
over("q_part_has_products", "SELECT k AS page_id, k % 7 IN (2, 3) AS has_products FROM part", _KINDS, lambda p: pages.has_product_content(_features(p)))
over("q_part_is_detail", "SELECT k AS page_id, k % 7 IN (2, 4) AS is_detail FROM part", _KINDS, lambda p: pages.is_detail_page(p, _features(p)))
over("q_part_shows_products", "SELECT k AS page_id, k % 3 <> 2 AS shows_products FROM part", forms("<p>only $[[z]].00</p>", "<p>Item # AB[[100 + k]]</p>", "<script>var p = '$1.00'; // SKU: ABC123</script><p>[[n]]</p>"), lambda p: pages.shows_products(dom.nodes(p)))
over("q_part_blocked", "SELECT k AS page_id, k % 2 = 0 AS blocked FROM part", forms("<p>Please solve this CAPTCHA, [[n]]</p>", "<p>[[n]]</p>"), lambda p: p.select("page_id", scoring.is_blocked_page(F.col("html")).alias("blocked")))
over(
    "q_part_frame", "SELECT k AS page_id, 'x' AS tag, CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS framed FROM part",
    forms('<div class="Breadcrumb-list"><p><x>a</x></p></div>', "<footer><x>a</x></footer>", '<div class="sidebar">' + "<i>" * 11 + "<x>a</x>" + "</i>" * 11 + "</div>"),
    lambda p: dom.in_frame(dom.nodes(p)).where("tag = 'x'").groupBy("page_id", "tag").agg(F.count_if("framed").alias("framed")),
)

# --- evidence ------------------------------------------------------------------------------------------------------
_CHUNKS = of('<meta name="product:x" content="c[[k]]"><p data-upc="1">t</p><script type="application/ld+json">{"a":[[k]]}</script><table><tr><td>UPC [[lpad(k, 12, \'5\')]]</td></tr></table>')
over(
    "q_part_evidence_chunks",
    """SELECT k AS page_id, CAST(0 AS INT) AS ord, 'meta' AS location, concat('name=product:x content=c', k, ' c', k) AS text FROM part UNION ALL SELECT k, 1, 'data_attr', 'data-upc=1' FROM part UNION ALL SELECT k, 2, 'json_ld', concat('{"a":', k, '}') FROM part
    UNION ALL SELECT k, 3, 'dom_specs', concat('UPC ', lpad(CAST(k AS VARCHAR), 12, '5')) FROM part UNION ALL SELECT k, 4, 'body_text', concat('t UPC ', lpad(CAST(k AS VARCHAR), 12, '5')) FROM part""",
    _CHUNKS, evidence.evidence_chunks,
)
over("q_part_evidence_upc", "SELECT k AS page_id, lpad(CAST(k AS VARCHAR), 12, '5') AS upc, 'dom_specs' AS evidence_location FROM part", _CHUNKS, lambda p: evidence.evidence_upc(evidence.evidence_chunks(p)))
over("q_part_clean_html", "SELECT k AS page_id, concat('<div data-x=\"', k, '\"><p>', n, ' &amp; co</p><br/><img src=\"/i\"/></div>') AS cleaned FROM part", of('<div class="a" id="b" data-x="[[k]]"><nav>menu<b>x</b></nav><script>1</script><p style="c">[[n]] &amp;   co</p><br><img src="/i" aria-label="y"></div><!-- c -->'), evidence.cleaned_pages)
over(
    "q_part_compact_listing", f"SELECT k AS page_id, concat('PAGE TITLE: T', k, chr(10), chr(10), '---', chr(10), chr(10), n, ' costs quite some money', chr(10), 'Links: ', n, ' -> {SITE}/p/', k, chr(10), chr(10), '---', chr(10), chr(10), 'T', k, chr(10), n, chr(10), 'costs quite some money') AS evidence FROM part",
    of('<title>T[[k]]</title><div class="item"><a href="/p/[[k]]">[[n]]</a> costs quite some money</div><script>no</script>'), evidence.compact_listings,
)


@query(
    "q_part_compact_detail",
    f"""SELECT k AS page_id, array_to_string(['TASK: Extract only the product matching the known listing SKU/name below. Ignore related, recommended, sponsored, and recently viewed products.', concat('DETAIL URL: {SITE}/p/', k), concat('KNOWN LISTING PRODUCT: ', n), concat('KNOWN SKU: S-', k), 'KNOWN PRICE: ', concat('BARCODE EVIDENCE (meta:upc): ', {CODE}), n, concat('META upc: ', {CODE}), concat('SKU: S-', k)], concat(chr(10), chr(10), '---', chr(10), chr(10))) AS evidence FROM {PART} part""",
)
def compact_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    stored = p.selectExpr("k AS page_id", f"concat('{SITE}/p/', k) AS url", f"{of(f'<h1>[[n]]</h1><meta name="upc" content="[[{CODE}]]"><ul><li>SKU: S-[[k]]</li></ul>')} AS html")
    return evidence.compact_details(stored, p.selectExpr(f"concat('{SITE}/p/', k) AS product_url", "n AS product_name", "concat('S-', k) AS sku", "'' AS price"))


over(
    "q_part_page_profiles", "SELECT k AS page_id, k % 2 = 0 AS possible_bot_block, true AS js_rendered_likely, concat('P', k) AS page_title, CAST(3 AS INT) AS candidate_count, 'div.big.item:2 div.card:1' AS top_patterns, CAST(1 AS INT) AS product_links_found, concat('/p/', k) AS samples FROM part",
    of('<title>P[[k]]</title><body><div class="item big">a</div><div class="card"><a href="/p/[[k]]">x</a></div><div class="big item">b</div><p>[[CASE WHEN k % 2 = 0 THEN \'Cloudflare\' ELSE \'fine\' END]]</p></body>'),
    lambda p: evidence.page_profiles(p).select("page_id", "possible_bot_block", "js_rendered_likely", "page_title", "candidate_count", F.array_join("top_patterns", " ").alias("top_patterns"), "product_links_found", F.array_join("product_link_samples", " ").alias("samples")),
)
_SCRIPTS = of('<script type="application/json">{"items":[{"name":"[[n]]","sku":"J-[[k]]","price":"[[z]]"},{"id":"m","url":"/i.jpg"}],"u":"/product/[[k]]"}</script><script id="__NEXT_DATA__">[{"title":"[[n]] next","gtin":"[[lpad(k, 12, \'3\')]]"}]</script><script>{"name":"no","sku":"no"}</script>')
over("q_part_script_products", "SELECT k AS page_id, n AS product_name, concat('J-', k) AS sku, '' AS upc, concat('$', z) AS price FROM part UNION ALL SELECT k, concat(n, ' next'), '', lpad(CAST(k AS VARCHAR), 12, '3'), '' FROM part", _SCRIPTS, lambda p: evidence.script_products(p).select("page_id", "product_name", "sku", "upc", "price"))
over("q_part_script_links", f"SELECT k AS page_id, concat('{SITE}/product/', k) AS product_url FROM part", _SCRIPTS, lambda p: evidence.script_links(p).select("page_id", "product_url"))


# --- payloads, feeds, model answers --------------------------------------------------------------------------------
def bodies(name: str, expected: str, body: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query of one payload for each part."""

    @query(name, expected.replace("FROM part", f"FROM {PART} part"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(parts(spark, sf_dir).selectExpr("k AS page_id", "k AS ord", f"'{LIST}' AS url", f"'{SITE}' AS root", f"{body} AS body"))


bodies(
    "q_part_hosted_rows",
    f"""SELECT k AS page_id, n AS product_name, concat('H-', k) AS sku, '' AS price, '' AS image_url, concat('{SITE}/p/', k) AS product_url FROM part WHERE k % 3 = 0
    UNION ALL SELECT k, concat('A ', n), '', concat('$', z, '.50'), concat('{SITE}/i/', k, '.jpg'), concat('{SITE}/item-', k) FROM part WHERE k % 3 = 1 UNION ALL SELECT k, 'Blue Cup', '', '', '', '{SITE}/product/blue-cup' FROM part WHERE k % 3 = 2""",
    forms(
        '{"data":{"json":{"products":[{"name":"[[n]]","itemNumber":"H-[[k]]","url":"/p/[[k]]"},{"title":"12 results for tea"},{"product_name":"[[n]]","sku":"H-[[k]]","price":"$[[z]]","imageUrl":"/i/h.jpg","product_url":"/p/[[k]]"}]}}}',
        '{"data":{"markdown":"1. [![A [[n]]](/i/[[k]].jpg)](/item-[[k]])\\n$[[z]].50\\n","links":["/product/blue-cup"]}}', '{"data":{"links":["/product/blue-cup","/product/blue-cup#x","mailto:x"]}}',
    ),
    lambda d: enrichment.hosted_rows(d).select("page_id", "product_name", "sku", "price", "image_url", "product_url"),
)
bodies(
    "q_part_payload_walk", f"SELECT k AS page_id, n AS product_name, b AS brand, concat('I-', k) AS sku, lpad(CAST(k AS VARCHAR), 13, '6') AS upc, concat('$', z, '.5') AS price, '{SITE}/i/s.jpg' AS image_url, concat('{SITE}/product/', k) AS product_url FROM part",
    of('{"data":{"Products":[{"product-Name":"[[n]]","brandName":"[[b]]","item_number":"I-[[k]]","gtin13":"[[lpad(k, 13, \'6\')]]","unitPrice":"[[z]].5","pdpUrl":"/product/[[k]]","imageUrl":["/i/s.jpg"]}],"media":[{"url":"/i/x.jpg","id":"m1"}]}}'), lambda d: payloads.walk_payloads(d).select(_S),
)
bodies("q_part_payload_links", f"SELECT k AS page_id, concat('{SITE}/product/', k) AS product_url FROM part UNION ALL SELECT k, concat('{SITE}/p/x-', k) FROM part", of('{"a":{"name":"x","url":"/product/[[k]]","more":["/p/skipped",{"deep":"/p/x-[[k]]"}],"about":"/about"}}'), lambda d: payloads.payload_links(d).select("page_id", "product_url"))
bodies(
    "q_part_markdown_cards", f"SELECT k AS page_id, concat('Fine ', n) AS product_name, concat('SY-', k) AS sku, concat('$', z, '.50') AS price, '{SITE}/i/1.jpg' AS image_url, concat('{SITE}/syrup-', k) AS product_url FROM part UNION ALL SELECT k, 'Red Towel', '', '$1,200.00', '{SITE}/i/2.jpg', '{SITE}/red-towel-77' FROM part",
    f"replace({of('1. [![x](/i/1.jpg)](/syrup-[[k]])~SY-[[k]]~$[[z]].50~## [Fine *[[n]]*](/syrup-[[k]])~2. [![Red Towel](/i/2.jpg)](/red-towel-77)~In Cart~$ 1,200.00~3. [![Again](/i/3.jpg)](/syrup-[[k]]/)~4. [![C](/i/4.jpg)](/cart/x)~5. [![O](/i/5.jpg)](https://o.example/x)~')}, '~', '\\n')",
    lambda d: payloads.markdown_cards(d).select("page_id", "product_name", "sku", "price", "image_url", "product_url"),
)
bodies(
    "q_part_model_rows", f"SELECT k AS page_id, n AS product_name, b AS brand, concat('T-', k) AS sku, lpad(CAST(k AS VARCHAR), 14, '1') AS upc, concat('$', z) AS price, '' AS image_url, '{SITE}/p/tea' AS product_url FROM part WHERE k % 2 = 0 UNION ALL SELECT k, n, '', '', '', '4', '', '' FROM part WHERE k % 2 = 1",
    forms('```json {"products": [{"name": "[[n]]", "manufacturer": "[[b]]", "model": "T-[[k]]", "gtin": "[[lpad(k, 14, \'1\')]]", "price": "$[[z]]", "url": "p/tea"}, {"name": "205 results for tea"}, {"title": "again", "url": "p/tea"}]} ```', '[{"name": "[[n]]", "price": 4}, "no row"]'),
    lambda d: payloads.model_rows(d).select(_S),
)
_FA = ["ord", "product_name", "brand", "sku", "upc", "price", "case_pack", "image_url", "product_url", "category", "description", "availability", "missing_upc"]
bodies(
    "q_part_feed_variants",
    f"""SELECT k AS ord, concat(n, ' S') AS product_name, 'Big Co' AS brand, concat('A-', k) AS sku, lpad(CAST(k AS VARCHAR), 12, '2') AS upc, concat('$', z, '.97') AS price, '12' AS case_pack, 'https://i/8.jpg' AS image_url, concat('{SITE}/products/h', k) AS product_url, 'Care; RegInv' AS category, 'Soft pads' AS description, 'Unavailable' AS availability, '0' AS missing_upc FROM part
    UNION ALL SELECT k, n, 'Big Co', concat('B-', k), '', concat('$', z + 10, '.00'), '12', 'https://i/7.jpg', concat('{SITE}/products/h', k), 'Care; RegInv', 'Soft pads', 'Available', '1' FROM part""",
    of('{"id":[[k]],"title":"[[n]]","vendor":"V","handle":"h[[k]]","body_html":"<p>Soft <b>pads</b></p>","tags":["Brand_Big_Co","case/12","Care","RegInv","In Stock"],"images":[{"id":7,"src":"https://i/7.jpg"},{"id":8,"src":"https://i/8.jpg"}],"variants":[{"id":1,"name":"[[n]] S","sku":"A-[[k]]","barcode":"[[lpad(k, 12, \'2\')]]","price":"[[z]].97","available":false,"image_id":8},{"id":2,"sku":"B-[[k]]","price":"[[(z + 10) * 100]]","available":true}]}'),
    lambda d: feeds.variant_rows(d).select(_FA),
)
bodies(
    "q_part_feed_attributes",
    f"""SELECT k AS ord, n AS product_name, b AS brand, lpad(CAST(k AS VARCHAR), 12, '4') AS upc, CASE k % 4 WHEN 0 THEN 'feed_upc' WHEN 1 THEN 'feed_attribute' WHEN 2 THEN 'feed_description' ELSE 'numeric_sku' END AS upc_source, concat('$', z, '.00') AS price, 'Home; Care' AS category, concat('{SITE}/product/s', k) AS product_url FROM part""",
    f"""concat({of('{"id":[[k]],"name":"[[n]]","slug":"s[[k]]","prices":{"currency_symbol":"$","currency_minor_unit":2,"price":"[[z * 100]]"},"categories":[{"name":"Home"},{"name":"Care"}],')}, CASE k % 4 WHEN 0 THEN {of('"upc":"[[lpad(k, 12, \'4\')]]","attributes":[{"name":"Brand","terms":[{"name":"[[b]]"}]}]}')}
        WHEN 1 THEN {of('"attributes":[{"name":"Brand","terms":[{"name":"[[b]]"}]},{"taxonomy":"pa_barcode","terms":[{"slug":"[[lpad(k, 12, \'4\')]]"}]}]}')} WHEN 2 THEN {of('"description":"<b>EAN</b>: [[lpad(k, 12, \'4\')]]","attributes":[{"name":"Manufacturer","terms":[{"name":"[[b]]"}]}]}')} ELSE {of('"sku":"[[lpad(k, 12, \'4\')]]","attributes":[{"name":"Brand","terms":[{"name":"[[b]]"}]}]}')} END)""",
    lambda d: feeds.attribute_rows(d).select("ord", "product_name", "brand", "upc", "upc_source", "price", "category", "product_url"),
)


@query(
    "q_part_feed_backfill",
    f"""SELECT k AS ord, concat('A-', k) AS sku, CASE k % 4 WHEN 0 THEN code WHEN 2 THEN code ELSE '' END AS upc FROM (SELECT k, lpad(CAST(k AS VARCHAR), 12, '5') AS code FROM {PART} part) UNION ALL SELECT k, CASE k % 4 WHEN 0 THEN 'S2' ELSE concat('B-', k) END, CASE WHEN k % 4 IN (0, 1) THEN code ELSE '' END FROM (SELECT k, lpad(CAST(k AS VARCHAR), 12, '5') AS code FROM {PART} part)""",
)
def feed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    feed = p.selectExpr("k AS ord", f"'{SITE}/' AS root", f"{of('{"id":[[k]],"title":"[[n]]","handle":"h[[k]]","variants":[{"id":1,"sku":"A-[[k]]"},{"id":2,"sku":"B-[[k]]"}]}')} AS body")
    code = "lpad(k, 12, '5')"
    html = f"""CASE k % 4 WHEN 0 THEN {of('x "selected_variant_drop" : {"id": 2, "note": "a } brace", "barcode": "[[lpad(k, 12, \'5\')]]", "sku": "S2"} y')} WHEN 1 THEN {of('{"sku" : "B-[[k]]", "a": 1, "mpn": "[[lpad(k, 12, \'5\')]]"}')} ELSE {of('{"barcode": "[[lpad(k, 12, \'5\')]]"}')} END"""
    stored = p.where("k % 4 < 3").selectExpr(f"concat('{SITE}/products/h', k) AS url", f"{html} AS html", f"{code} AS c")
    return feeds.variant_rows(enrichment.fill_feed(feed, stored)).select("ord", "sku", "upc")


# --- crawls --------------------------------------------------------------------------------------------------------
_SITE = "concat('https://c', k, '.example/list', CASE WHEN p = 1 THEN '' ELSE concat('?page=', p) END)"
_STORED = "(p < 3 OR k % 5 <> 4)"


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of each part's listing: with links to the next, or with a count of rows; some third ones aren't stored."""
    html = f"""concat({of('<script type="application/ld+json">{"@type":"Product","name":"[[n]] [[p]]","url":"/product/[[CASE WHEN p = 3 THEN 1 ELSE p END]]"}</script><img src="/x.png"><a href="/product/[[CASE WHEN p = 3 THEN 1 ELSE p END]]">x</a>')},
        CASE WHEN k % 2 = 0 AND p < 3 THEN {of('<ul class="pagination"><li><a href="?page=[[p + 1]]">Next</a></li></ul>')} WHEN p = 1 THEN '<p>Items 1-2 of 6</p><link rel="next" href="?page=2">' ELSE '' END)"""
    return parts(spark, sf_dir).selectExpr("k", "n", "explode(sequence(1, 3)) AS p").where(_STORED).selectExpr("k * 10 + p AS page_id", f"{_SITE} AS url", f"{html} AS html")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).selectExpr("k AS crawl", "concat('https://c', k, '.example/list') AS url")


_CRAWLED = f"(SELECT k, n, p FROM {PART} part, (VALUES (1), (2), (3)) t(p) WHERE {_STORED})"


@query(
    "q_part_crawl_visits",
    f"""SELECT k AS crawl, CAST(p AS INT) AS page_num, {_SITE} AS url, k * 10 + p AS page_id, CASE WHEN p = 3 AND k % 2 = 0 THEN 'navigation exhausted after page 3' WHEN p = 3 THEN 'all 3 expected page(s) visited; no further navigation found' WHEN p = 2 AND k % 5 = 4 THEN concat('page not stored: https://c', k, '.example/list?page=3') END AS stop_reason FROM {_CRAWLED}""",
)
def crawl_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.visits(_starts(spark, sf_dir), crawled(spark, sf_dir)).drop("expected")


@query("q_part_crawl_products", f"SELECT k AS crawl, CAST(p AS INT) AS page_num, concat(n, ' ', p) AS product_name, concat('https://c', k, '.example/product/', p) AS product_url FROM {_CRAWLED} WHERE p < 3")
def crawl_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = crawled(spark, sf_dir)
    visited = crawl.visits(_starts(spark, sf_dir), stored)
    return crawl.crawl_products(visited, stored, lambda p: structured.jsonld(p, dom.nodes(p)), [F.col("product_url")]).select("crawl", "page_num", "product_name", "product_url")


@query("q_part_crawl_links", f"SELECT k AS crawl, CAST(p AS INT) AS page_num, concat('https://c', k, '.example/product/', p) AS product_url FROM {_CRAWLED} WHERE p < 3")
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = crawled(spark, sf_dir)
    return crawl.crawl_links(crawl.visits(_starts(spark, sf_dir), stored), stored).select("crawl", "page_num", "product_url")


over(
    "q_part_page_numbers", "SELECT k AS page_id, CAST(z + 10 AS INT) AS highest, '?page=2' AS next_href, CAST(k % 3 AS INT) AS tier FROM part",
    f"""concat({of('<div class="Pagination"><a href="?page=1">1</a><span>2</span><button>[[z + 10]]</button><i>999</i></div><b>9999</b>')}, {forms('<a rel="next" href="?page=2">x</a><a aria-label="Next page" href="?page=3">y</a>', '<a href="?page=9">1</a><a aria-label="Next page" href="?page=2">y</a><a href="?page=4">next</a>', '<a href="?page=2">Next</a><a href="?page=5">next</a>')})""",
    lambda p: dom.highest_page_button(dom.nodes(p)).join(dom.next_links(dom.nodes(p)), "page_id").select("page_id", "highest", "next_href", "tier"),
)
_T = "CAST(z % 7 + 2 AS VARCHAR)"
simple(
    "q_rendered_page_urls",
    f"""SELECT k, array_to_string(list_concat(list_transform(['page', 'p', 'pg', 'pageNumber', 'page_number', 'currentPage', 'current_page', 'pageIndex', 'page_index'], lambda x: concat('{LIST}?per_page=20&q=x&', x, '=', {_T})), list_transform(['offset', 'start', 'skip'], lambda x: concat('{LIST}?per_page=20&q=x&', x, '=', (z % 7 + 1) * 20)), [concat('{LIST}/page/', {_T}, '?per_page=20&q=x')]), ' ') AS urls FROM part""",
    lambda: F.array_join(url.rendered_page_urls(F.lit(f"{LIST}?per_page=20&q=x"), F.col("z") % 7 + 2), " ").alias("urls"),
)
simple(
    "q_listing_page_urls",
    f"""SELECT k, array_to_string(list_concat(list_transform(['page', 'p', 'pg', 'pageNumber', 'Page', 'currentPage'], lambda x: concat('{LIST}/page/3/?q=x&', x, '=', {_T})), CASE WHEN z % 7 = 1 THEN [] ELSE [concat('{LIST}/page/', {_T}, '/?q=x')] END), ' ') AS urls FROM part""",
    lambda: F.array_join(url.listing_page_urls(F.lit(f"{LIST}/page/3/?q=x"), F.col("z") % 7 + 2), " ").alias("urls"),
)
simple(
    "q_numbered_page_url", f"SELECT k, concat('{LIST}?q=', n[1:1], CASE WHEN k % 2 = 0 THEN '&pg=' ELSE '&page=' END, {_T}) AS url FROM part",
    lambda: url.numbered_page_url(F.concat(F.lit(f"{LIST}?q="), F.substring("n", 1, 1), F.when(F.col("k") % 2 == 0, "&pg=1").otherwise("")), F.col("z") % 7 + 2).alias("url"),
)
simple(
    "q_feed_bases", f"SELECT k, CASE WHEN k % 2 = 0 THEN concat('{SITE}/collections/c', k, '/products.json {SITE}/products.json') ELSE '{SITE}/products.json' END AS bases FROM part",
    lambda: F.array_join(url.feed_base_urls(F.concat(F.lit(SITE), F.when(F.col("k") % 2 == 0, F.concat(F.lit("/collections/c"), "k", F.lit("/products/x/"))).otherwise("/shop"))), " ").alias("bases"),
)
simple(
    "q_stable_sort", f"SELECT k, CASE k % 5 WHEN 0 THEN '{SITE}/collections/x?sort_by=title-ascending' WHEN 1 THEN '{SITE}/collections/x?a=1&sort_by=title-ascending' WHEN 2 THEN '{SITE}/collections/x?sort_by=price' WHEN 3 THEN '{SITE}/shop' ELSE '{SITE}/collections/x' END AS url FROM part",
    lambda: url.stable_sort(F.when(F.col("k") % 5 == 4, "<p>plain</p>").otherwise("<link href=//cdn.shopify.com/x>"), F.concat(F.lit(SITE), F.expr("element_at(array('/collections/x', '/collections/x?a=1', '/collections/x?sort_by=price', '/shop', '/collections/x'), cast(k % 5 + 1 AS int))"))).alias("url"),
)
simple(
    "q_page_variants", f"SELECT k, CASE k % 3 WHEN 0 THEN concat('{LIST}?pg=', {_T}, '&offset=0') WHEN 1 THEN concat('{LIST}/page/2/?page=', {_T}, ' {LIST}/page/', {_T}, '/') ELSE concat('{LIST}?offset=40&page=', {_T}, ' {LIST}?offset=', (z % 7 + 1) * 20) END AS urls FROM part",
    lambda: F.array_join(url.page_urls(F.concat(F.lit(LIST), F.expr("element_at(array('?pg=1&offset=0', '/page/2/', '?offset=40'), cast(k % 3 + 1 AS int))")), F.col("z") % 7 + 2, F.when(F.col("k") % 3 == 2, 20)), " ").alias("urls"),
)
simple(
    "q_ranged_pagination", "SELECT k, CASE WHEN k % 3 = 0 THEN CAST(k + 1000 AS INT) END AS total_products, CASE WHEN k % 3 = 0 THEN CAST(24 AS INT) END AS per_page, CASE WHEN k % 3 = 0 THEN CAST(ceil((k + 1000) / 24) AS INT) END AS total_pages FROM part",
    lambda: url.ranged_pagination(F.when(F.col("k") % 3 == 0, F.concat(F.lit("Showing 1 - 24 of "), F.format_number(F.col("k") + 1000, 0))).when(F.col("k") % 3 == 1, F.lit("page 2 of 9")).otherwise("77 items")).alias("p").getField("total_products").alias("total_products"),
    lambda: url.ranged_pagination(F.when(F.col("k") % 3 == 0, F.concat(F.lit("Showing 1 - 24 of "), F.format_number(F.col("k") + 1000, 0))).when(F.col("k") % 3 == 1, F.lit("page 2 of 9")).otherwise("77 items")).getField("per_page").alias("per_page"),
    lambda: url.ranged_pagination(F.when(F.col("k") % 3 == 0, F.concat(F.lit("Showing 1 - 24 of "), F.format_number(F.col("k") + 1000, 0))).when(F.col("k") % 3 == 1, F.lit("page 2 of 9")).otherwise("77 items")).getField("total_pages").alias("total_pages"),
)
_COUNTED = lambda: url.counted_pagination(F.when(F.col("k") % 2 == 0, F.concat(F.lit("1-24 of "), F.col("k") + 30)).otherwise(F.concat(F.col("k") + 5, F.lit(" results"))), F.when(F.col("k") % 3 == 0, F.array(F.lit(1), F.col("z") + 3)).otherwise(F.array(F.lit(1))))
simple("q_counted_pagination", "SELECT k, CAST(CASE WHEN k % 2 = 0 THEN k + 30 ELSE k + 5 END AS INT) AS total_products, CASE WHEN k % 3 = 0 THEN CAST(z + 3 AS INT) END AS total_pages FROM part", lambda: _COUNTED()["total_products"].alias("total_products"), lambda: _COUNTED()["total_pages"].alias("total_pages"))
simple(
    "q_stop_reasons",
    """SELECT k, CASE WHEN k % 4 = 0 THEN concat('navigation exhausted after page ', z) WHEN z > k % 4 * 10 THEN concat('navigation exhausted after ', z, ' page(s); detected estimate was ', k % 4 * 10) WHEN z < k % 4 * 10 THEN concat('no navigation path found after page ', z) ELSE concat('all ', z, ' expected page(s) visited; no further navigation found') END AS reason FROM part""",
    lambda: crawl.exhausted_reason((F.col("k") % 4 * 10).cast("int"), F.col("z")).alias("reason"),
)
simple("q_enrichment_cap", "SELECT k, CASE WHEN k % 3 > 0 AND z > k % 3 * 10 AND NOT (k % 2 = 1 AND z % 5 > 2) THEN CAST(k % 3 * 10 AS INT) END AS cap FROM part", lambda: crawl.enrichment_cap((F.col("k") % 3 * 10).cast("int"), F.when(F.col("k") % 2 == 1, 2), F.col("z") % 5, F.col("z")).alias("cap"))

# --- texts, money, identifiers -------------------------------------------------------------------------------------
simple("q_clean_strings", "SELECT k, concat(n, ' & ', b, ' <x> é') AS clean FROM part", lambda: text.clean_string(F.concat(F.lit("  "), "n", F.lit("\u0007 &amp;\n"), "b", F.lit(" &lt;x&gt; &eacute; "))).alias("clean"))
simple("q_detail_names", "SELECT k, concat(n, ' ', b) AS name FROM part", lambda: text.detail_name(F.concat(F.lit(" - "), "n", F.lit("   "), "b", F.when(F.col("k") % 2 == 0, F.lit(" | NASSAU candy ")).otherwise(" |"))).alias("name"))
simple("q_label_keys", "SELECT k, concat('item no ', n) AS label FROM part", lambda: text.label_key(F.concat(F.lit(" Item.  No: "), F.upper("n"), F.lit("::"))).alias("label"))
simple("q_unit_from_pack", "SELECT k, CASE k % 4 WHEN 0 THEN 'own' WHEN 1 THEN concat(z, ' FL OZ') WHEN 2 THEN '' ELSE concat(z, '.5ML') END AS unit_size FROM part", lambda: text.unit_size_or_pack(F.when(F.col("k") % 4 == 0, "own").otherwise(""), F.concat(F.col("z").cast("string"), F.expr("element_at(array(' oz', ' fl oz', ' per case', '.5ml'), cast(k % 4 + 1 AS int))"))).alias("unit_size"))
simple("q_run_labels", "SELECT k, concat('s', k, '.example — 07:', lpad(CAST(z AS VARCHAR), 2, '0'), ' 05/03/2026') AS label FROM part", lambda: text.run_label(F.concat(F.lit("https://www.s"), "k", F.lit(".example/a")), F.expr("make_timestamp_ntz(2026, 3, 5, 7, z, 0)")).alias("label"))
simple("q_normal_titles", "SELECT k, concat(n, ' box') AS title, CASE k % 4 WHEN 0 THEN 'SYSCO' WHEN 1 THEN 'US FOODS' WHEN 2 THEN 'KRAFT' ELSE '' END AS sku_brand, CASE k % 3 WHEN 0 THEN CAST(z AS VARCHAR) WHEN 1 THEN '24' ELSE '' END AS cases FROM part", lambda: text.normal_title(F.concat("n", F.lit(" rego trading inc  box -"))).alias("title"), lambda: text.sku_brand(F.concat(F.expr("element_at(array('sys', 'USF', 'k-', 'none'), cast(k % 4 + 1 AS int))"), "k")).alias("sku_brand"), lambda: text.case_count(F.when(F.col("k") % 3 == 0, F.concat(F.lit("Case of "), "z")).when(F.col("k") % 3 == 1, "x 24ct").otherwise("none")).alias("cases"))
simple("q_brand_case", "SELECT k, CASE k % 3 WHEN 0 THEN 'Frito LAY' WHEN 1 THEN concat('ACME ', upper(n[1:2])) ELSE concat('O''Neil''S ', upper(n[1:1]), n[2:3], 'ware') END AS brand FROM part", lambda: text.brand_case(F.when(F.col("k") % 3 == 0, "frito lay").when(F.col("k") % 3 == 1, F.concat(F.lit("ACME "), F.substring("n", 1, 2))).otherwise(F.concat(F.lit("o'neil's "), F.substring("n", 1, 3), F.lit("ware")))).alias("brand"))
simple("q_title_brands", "SELECT k, CASE k % 4 WHEN 0 THEN 'TOOTSIE ROLL' WHEN 1 THEN 'KRAFT' WHEN 2 THEN 'ACME GREEN TEA' ELSE '' END AS brand FROM part", lambda: text.title_brand(F.when(F.col("k") % 4 == 0, F.concat(F.lit("Tootsie Roll "), "n")).when(F.col("k") % 4 == 1, F.concat(F.lit("kraft, "), "n")).when(F.col("k") % 4 == 2, "Acme Green Tea").otherwise(F.concat(F.lit("one two three four "), "n"))).alias("brand"))
simple("q_retail_queries", "SELECT k, CASE k % 3 WHEN 0 THEN concat(b, ' ', n, ' 5 OZ|', b, ' ', n, '|', n, ' 5 OZ|', n) WHEN 1 THEN concat(n, '|', n, ' 12 count') ELSE concat(b, ' ', n, '|', n) END AS asked FROM part", lambda: F.array_join(text.retail_queries(F.when(F.col("k") % 3 != 1, F.col("b")), F.col("n"), F.when(F.col("k") % 3 == 0, "5 OZ"), F.when(F.col("k") % 3 == 1, "12")), "|").alias("asked"))
simple("q_plain_dollars", "SELECT k, concat('$', k, '234.50') AS plain, k % 4 = 0 OR k % 4 = 1 AS page_wide FROM part", lambda: money.plain_dollars(F.concat(F.lit("was $ "), "k", F.lit(",234.50 now $1"))).alias("plain"), lambda: money.is_page_wide_price(F.when(F.col("k") % 4 == 0, "$1,500.00").when(F.col("k") % 4 == 1, "$50.00").otherwise("$49.99"), F.lit("$10.00"), F.when(F.col("k") % 4 == 3, "CASE").otherwise("ea")).alias("page_wide"))
simple("q_site_prices", "SELECT k, concat('$', z, '.50') AS price, CASE WHEN k % 2 = 0 THEN concat('$', z, '.50') ELSE '' END AS unit_price, CASE WHEN k % 2 = 0 THEN 'EACH' ELSE '' END AS pricing_unit FROM part", *(lambda c=c: money.site_price(F.when(F.col("k") % 2 == 0, F.concat(F.lit("from $99.00 now $"), "z", F.lit(".50 /Each"))).otherwise(F.concat(F.lit("now $"), "z", F.lit(".50 or $9.00"))))[c].alias(c) for c in ("price", "unit_price", "pricing_unit")))
simple("q_identifier_fields", f"SELECT k, CASE WHEN length({CODE}) IN (8, 13) THEN {CODE} ELSE '' END AS ean, CASE WHEN length({CODE}) = 14 THEN {CODE} ELSE '' END AS gtin, CASE length({CODE}) WHEN 8 THEN 'ean8' WHEN 12 THEN 'upc' WHEN 13 THEN 'ean13' ELSE 'gtin14' END AS identifier_type FROM part", *(lambda c=c: ids.identifier_fields(F.expr(CODE))[c].alias(c) for c in ("ean", "gtin", "identifier_type")))
simple("q_first_valid_code", f"SELECT k, {CODE} AS code, CASE k % 4 WHEN 0 THEN '012345678905' WHEN 3 THEN '012345600012' ELSE '' END AS upc12, CASE k % 4 WHEN 0 THEN '012345678905' WHEN 3 THEN '012345600012' ELSE '' END AS labelled FROM part", lambda: ids.first_valid(F.lit("12345678 and"), F.concat(F.lit("4-006381-333932, then "), F.expr(CODE))).alias("code"), lambda: ids.upc12(F.expr(CODE)).alias("upc12"), lambda: ids.labelled_upc(F.concat(F.lit("Model 7; UPC no: "), F.expr(CODE))).alias("labelled"))
simple("q_sku_validity", "SELECT k, k % 4 IN (0, 1) AS catalog_sku, k % 4 IN (0, 1, 2) AS detail_sku FROM part", lambda: ids.is_catalog_sku(F.concat(F.expr("element_at(array('AB-', '1/', 'A ', 'image-'), cast(k % 4 + 1 AS int))"), F.col("k") + 100)).alias("catalog_sku"), lambda: ids.is_detail_sku(F.concat(F.expr("element_at(array('AB-', '1/', 'A ', 'im_age-'), cast(k % 4 + 1 AS int))"), F.col("k") + 100)).alias("detail_sku"))
simple(
    "q_aggregate_rows", "SELECT k, k % 4 IN (0, 2) AS is_summary FROM part",
    lambda: scoring.is_summary_row({"product_name": F.expr("element_at(array(concat(k, ' results for tea'), n, 'Showing 1-24 of 99', concat(k, ' items for tea')), cast(k % 4 + 1 AS int))"), "sku": F.when(F.col("k") % 4 == 3, "S1").otherwise(""), "upc": F.lit(""), "product_url": F.lit("")}).alias("is_summary"),
)
_VALID = lambda: scoring.valid_detail({"product_name": F.expr("element_at(array('Page Not Found', '', 'Acme', n), cast(k % 4 + 1 AS int))"), "sku": F.lit(""), "price": F.when(F.col("k") % 8 == 2, "$1").otherwise(""), "upc": F.lit(""), "image_url": F.when(F.col("k") % 4 == 2, "/Logo.png").otherwise("")})
simple("q_valid_details", "SELECT k, k % 4 = 3 OR k % 8 = 2 AS is_valid, CASE k % 4 WHEN 0 THEN 'error title: Page Not Found' WHEN 1 THEN 'no trusted product fields' WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 'ok' ELSE 'site-level title without product fields' END ELSE 'ok' END AS reason FROM part", lambda: _VALID()["is_valid"].alias("is_valid"), lambda: _VALID()["reason"].alias("reason"))


@query("q_supplement_needed", f"SELECT b, count(*) < 5 OR count(*) < 50 * 0.5 AS supplement, count(*) FILTER (k % 3 = 0) < 3 AS model FROM {PART} part GROUP BY b")
def supplement_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = {"product_name": F.col("n"), "product_url": F.lit(""), "sku": F.when(F.col("k") % 3 == 0, "x"), "price": F.lit("")}
    found = parts(spark, sf_dir).groupBy("b").agg(F.count("*").alias("rows"), F.count_if(scoring.is_useful(row)).alias("useful"))
    return found.select("b", scoring.wants_supplement(F.col("rows"), F.lit(50)).alias("supplement"), scoring.wants_model(F.lit(True), F.col("useful")).alias("model"))


# --- enrichment ----------------------------------------------------------------------------------------------------
@query("q_enrich_first", f"SELECT k AS ord, CASE WHEN k % 2 = 0 AND k < 400 THEN concat('detail ', n) ELSE n END AS product_name FROM {PART} part")
def enrich_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row has a URL, so a cap of 200 rows ends at key 400."""
    p = parts(spark, sf_dir)
    listing = p.selectExpr("k AS ord", "n AS product_name", "CASE WHEN k % 2 = 0 THEN concat('u', k) ELSE '' END AS product_url")
    return enrichment.enrich_first(listing, p.selectExpr("k AS ord", "concat('detail ', n) AS product_name", "concat('u', k) AS product_url"), 200).select("ord", "product_name")


@query("q_fill_from_base", f"SELECT k, CASE WHEN k % 2 = 0 THEN n ELSE CASE WHEN k % 3 = 0 THEN 'from chosen' ELSE 'from primary' END END AS product_name, CASE WHEN k % 3 = 0 THEN 'c.jpg' ELSE 'p.jpg' END AS image_url FROM {PART} part")
def fill_from_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    details = p.selectExpr("k", "concat('c', k) AS chosen_url", "concat('p', k) AS primary_url", "CASE WHEN k % 2 = 0 THEN n ELSE '' END AS product_name", "'' AS image_url")
    side = lambda ok, mark, name, image: p.where(ok).selectExpr("k AS ord", f"concat('{mark}', k) AS product_url", f"'{name}' AS product_name", f"'{image}' AS image_url")
    return enrichment.fill_from_base(details, side("k % 3 = 0", "c", "from chosen", "c.jpg").unionByName(side("true", "p", "from primary", "p.jpg"))).select("k", "product_name", "image_url")


def _public(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = parts(spark, sf_dir)
    listing = p.selectExpr("k AS ord", "n AS product_name", "concat('$', z) AS price", "'' AS sku", "concat('u', k) AS product_url", "'' AS upc", "'' AS image_url")
    more = p.where("k % 10 = 0").selectExpr("k + 1000000 AS ord", "n AS product_name", "'' AS price", "'' AS sku", "concat('u', k) AS product_url", "'' AS upc", "'' AS image_url")
    detail_rows = p.where("k % 3 > 0").selectExpr("k AS ord", "CASE WHEN k % 3 = 1 THEN concat('rich ', n) ELSE 'Access Denied' END AS product_name", "'' AS price", "concat('S', k) AS sku", "concat('u', k) AS product_url", "'' AS upc", "'' AS image_url")
    return p.where("k % 2 = 0").selectExpr("concat('u', k) AS product_url"), listing.unionByName(more), detail_rows


@query("q_enrich_public", f"SELECT concat('u', k) AS product_url, CASE WHEN k % 3 = 1 THEN concat('rich ', n) ELSE n END AS product_name, CASE WHEN k % 3 = 1 THEN concat('S', k) ELSE '' END AS sku, concat('$', z) AS price FROM {PART} part WHERE k % 2 = 0")
def enrich_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich_public(*_public(spark, sf_dir)).select("product_url", "product_name", "sku", "price")


@query("q_static_catalog", f"SELECT k AS ord, concat('u', k) AS product_url, CASE WHEN k % 6 = 4 THEN concat('rich ', n) ELSE n END AS product_name, CASE WHEN k % 6 = 4 THEN concat('S', k) ELSE '' END AS sku FROM {PART} part")
def static_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.dedup import first_of_each

    links, listing, detail_rows = _public(spark, sf_dir)
    return enrichment.static_catalog(listing, links, detail_rows, lambda df: first_of_each(df, F.col("product_url"))).select("ord", "product_url", "product_name", "sku")


@query("q_best_provider", f"SELECT k AS ord, CASE WHEN k % 3 = 0 THEN 'go_upc' ELSE 'upcitemdb' END AS provider, CASE WHEN k % 3 = 2 THEN 'medium' ELSE 'high' END AS confidence FROM {PART} part WHERE k % 4 <> 3 OR k % 3 = 0")
def best_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider is sure, fairly sure or not at all; the second, asked for some, never more than fairly; a third answers every third row."""
    found = parts(spark, sf_dir).selectExpr(
        "k AS ord", """explode(array(struct('upcitemdb' AS provider, 0 AS position, CASE WHEN k % 4 = 3 THEN '' ELSE '1' END AS upc, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence),
            struct('go_upc' AS provider, 1 AS position, '2' AS upc, CASE k % 3 WHEN 0 THEN 'high' ELSE 'low' END AS confidence), struct('late' AS provider, 2 AS position, '3' AS upc, CASE k % 3 WHEN 0 THEN 'high' ELSE '' END AS confidence))) AS x"""
    ).select("ord", "x.*")
    return enrichment.best_provider(found).select("ord", "provider", "confidence")


_RESULTS = "60 + (k * 7 + p * 13) % 40 - CASE p WHEN 1 THEN 10 WHEN 2 THEN 25 ELSE 0 END"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, p) AS rank FROM (SELECT k, p, {_RESULTS} AS score FROM {PART} part, (VALUES (0), (1), (2)) t(p)) WHERE score >= 45)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).selectExpr("k", "n", "explode(sequence(0, 2)) AS p").selectExpr(
        "k AS ord", "p AS position", "n AS title", "CASE WHEN p = 1 THEN 'a Bundle of two' ELSE 'fine' END AS description", "concat('https://r.example/', CASE WHEN p = 2 THEN 'browse/' ELSE 'ip/' END, k, '-', p) AS url", "'r' AS site", "cast(60 + (k * 7 + p * 13) % 40 AS int) AS score"
    )
    return enrichment.rank_results(rows, 6)


@query("q_rank_results", f"SELECT k AS ord, CAST(p AS INT) AS position, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank, CASE WHEN score >= 78 THEN 'high' WHEN score >= 58 THEN 'medium' ELSE '' END AS confidence FROM {_RANKED}")
def rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("ord", "position", F.col("score").cast("int").alias("score"), "rank", "confidence")


@query(
    "q_resolve_products",
    f"SELECT k AS ord, lpad(CAST(k AS VARCHAR), 12, '1') AS upc, CAST(p AS INT) AS position, 'retail candidate matched strongly and explicit UPC found in dom_specs' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS first FROM {_RANKED} WHERE score >= 78 AND (k + p) % 2 = 0) WHERE first = 1",
)
def resolve_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    upcs = parts(spark, sf_dir).selectExpr("k", "explode(sequence(0, 2)) AS p").where("(k + p) % 2 = 0").selectExpr("concat('https://r.example/', CASE WHEN p = 2 THEN 'browse/' ELSE 'ip/' END, k, '-', p) AS url", "lpad(cast(k AS string), 12, '1') AS upc", "'dom_specs' AS evidence_location")
    return enrichment.resolve_products(enrichment.accepted_results(_ranked(spark, sf_dir), upcs)).select("ord", "upc", "position", "reason")


simple(
    "q_search_candidates", "SELECT k, concat(n, '   ', z, 'oz') AS title, concat(z, ' OZ') AS pack_size, CAST(CASE k % 3 WHEN 0 THEN -18 WHEN 1 THEN -25 ELSE 0 END AS INT) AS noise FROM part",
    *(lambda c=c: scoring.search_candidate(F.concat("n", F.lit(" <<<ad>>> "), "z", F.lit("oz")), F.lit(""), F.lit("u"), F.lit("s"))[c].alias(c) for c in ("title", "pack_size")),
    lambda: F.when(F.col("k") % 3 == 0, scoring.result_noise(F.lit("Variety Pack bundle"), F.lit("plus shipping"), F.lit("x"))).when(F.col("k") % 3 == 1, scoring.result_noise(F.col("n"), F.lit(""), F.lit("/c/kp/tea"))).otherwise(scoring.result_noise(F.col("n"), F.lit(""), F.lit("/ip/1"))).cast("int").alias("noise"),
)


@query(
    "q_outcome_counts",
    f"SELECT b, count(*) FILTER (k % 7 = 0) AS already, count(*) FILTER (k % 7 = 1) AS enriched, count(*) FILTER (k % 7 = 2) AS missing, count(*) FILTER (k % 7 IN (3, 4)) AS provider_unavailable, count(*) FILTER (k % 7 = 5) AS insufficient_data, count(*) FILTER (k % 7 = 6) AS skipped_budget FROM {PART} part GROUP BY b",
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "element_at(array('native', 'externally_resolved', 'no_match_found', 'provider_unavailable', 'provider_partially_unavailable', 'insufficient_data', 'external_lookup_skipped_budget'), cast(k % 7 + 1 AS int)) AS resolution_status"
    return enrichment.outcome_counts(parts(spark, sf_dir).selectExpr("b", "CASE WHEN k % 7 = 0 THEN '012345678905' ELSE '' END AS upc_12", status), ["b"])


@query("q_diagnostics", f"SELECT b, products, CAST(len(w) AS INT) AS n_warnings, CAST(CASE WHEN products < 200 THEN 200 ELSE 0 END AS INT) AS expected FROM (SELECT b, count(*) AS products, list_filter(['barcode', CASE WHEN count(*) < 200 AND count(*) / 200 < 0.9 THEN 'products' END, 'pages', 'stop', CASE WHEN count(*) < 3 THEN 'few' END], lambda x: x IS NOT NULL) AS w FROM {PART} part GROUP BY b)")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row has a barcode, three of five pages were seen and the stop is not an ordinary one; small runs expect 200 rows."""
    products = parts(spark, sf_dir).selectExpr("k AS ord", "b", "n AS product_name", "'' AS price", "concat('S', k) AS sku", "'' AS upc", "concat('u', k) AS product_url")
    crawls = products.groupBy("b").agg(F.count("*").alias("c")).selectExpr("b", "CASE WHEN c < 200 THEN 200 ELSE 0 END AS expected_products", "5 AS expected_pages", "3 AS pages_visited", "'time limit' AS stop_reason")
    return enrichment.diagnostics(products, crawls, ["b"]).select("b", "products", F.size("warnings").alias("n_warnings"), F.col("crawl.expected_products").alias("expected"))


@query("q_feed_counts", f"SELECT b, count(DISTINCT k // 2) AS feed_products, count(*) AS rows, count(*) FILTER (k % 3 = 0) AS rows_with_barcode, count(*) FILTER (k % 6 = 0) AS barcodes_from_detail, round_even(count(*) FILTER (k % 3 = 0) / count(*), 3) AS barcode_share FROM {PART} part GROUP BY b")
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).selectExpr("b", "cast(floor(k / 2) AS string) AS source_product_id", "CASE WHEN k % 3 = 0 THEN '1' ELSE '' END AS upc", "CASE WHEN k % 6 = 0 THEN 'detail_upc' ELSE '' END AS upc_source")
    return enrichment.feed_counts(rows, ["b"])


@query("q_page_slice", f"SELECT k FROM {PART} part ORDER BY k LIMIT 25 OFFSET 40")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice is the feature: rows 41 to 65."""
    return merge.page_slice(parts(spark, sf_dir).select("k"), [F.asc("k")], 40, 25)


@query("q_top_patterns", "SELECT page_id, pattern, n FROM (SELECT page_id, pattern, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS r FROM (SELECT page_id, tag AS pattern, count(*) AS n, min(i) AS f FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(li|p|article|nav|h1|ul|footer)[ >]', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(li|p|article|nav|h1|ul|footer)[ >]', 1), 1) AS i FROM pages) GROUP BY 1, 2)) WHERE r <= 2")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dom.nodes(load(spark, sf_dir, "pages")).where(F.col("tag").isin("li", "p", "article", "nav", "h1", "ul", "footer"))
    return pages.top_patterns(n, 2, F.col("tag")).select("page_id", "pattern", "n")


@query("q_suspicious_prices", f"SELECT k, CASE WHEN odd THEN concat('$', z, '.50') ELSE '$1' END AS price FROM (SELECT k, z, b, count(*) OVER (PARTITION BY b) >= 6 AS odd FROM {PART} part)")
def suspicious_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a brand share one price, so brands of six rows or more take the strict one."""
    rows = parts(spark, sf_dir).selectExpr("k", "b AS page_id", "'$1' AS price", "concat('$', z, '.50') AS strict_price")
    return cards.suspicious_prices(rows).select("k", "price")

