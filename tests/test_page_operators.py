"""Operators that walk a page's tree, held against small pages; and what can be plugged in."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import url
from shelfspark.operators import cards, crawl, detail_page, enrichment, evidence, layouts, payloads, quality, structured, targets
from shelfspark.plans import registry
from shelfspark.sources import nodes as dom
from shelfspark.sources.dom import Page

U = "https://s.example/list"


def test_page_tree():
    p = Page("<body><p>a <b>b</b> c<ul><li>x<li>y</ul><script>var s = '<p>';</script></body>")
    assert p.text() == "a b c x y" and p.text(p.all("p")[0]) == "a b c x y" and [p.text(k) for k in p.all("li")] == ["x", "y"]
    ul = p.all("ul")[0]
    assert [p.tag(k) for k in p.kids(ul)] == ["li", "li"] and p.after(p.kids(ul)[0]) == p.kids(ul)[1] and p.after(p.kids(ul)[1]) is None
    assert p.source(p.all("script")[0]) == "var s = '<p>';" and [p.tag(k) for k in p.up(p.all("b")[0])] == ["p", "body"]
    deep = Page("<div>" * 3000 + "x" + "</div>" * 3000)
    assert deep.text() == "x" and len(deep.nodes) == 3000


def test_deep_pages_and_payloads(spark):
    df = spark.createDataFrame([(1, "<div>" * 2000 + "word " * 50, U)], "page_id long, html string, url string")
    assert dom.nodes(df).count() == 2000
    deep = '{"a":' * 3000 + '{"name":"Tea","sku":"1"}' + "}" * 3000
    rows = [(1, U, deep), (2, U, "[" * 100_000), (3, U, '{"name":"Cup","sku":"2"}')]
    got = payloads.walk_payloads(spark.createDataFrame(rows, "page_id long, url string, body string")).select("page_id", "product_name").collect()
    assert (3, "Cup") in [tuple(r) for r in got] and len(got) <= 2


@pytest.mark.parametrize(
    "text,price",
    [
        ("Plus Member Price $ 5.00 / Each", "$ 5.00/Each"), ("$9.00 Sale Price $7.50", "$7.50"), ("$3.00 Regularly $9.00", "$3.00"), ("$9.00 $8.00 $0", "$8.00"), ("$19.46 BX", "$19.46/BX"), ("call us", "call us"), ("Last purchased $2.00", "$2.00"),
    ],
)
def test_price_texts(text, price):
    assert cards.price_text(text) == price


def test_card_sources():
    name = lambda html: cards.name_of(Page(f'<div class="card">{html}</div>'), 0)
    assert name('<span data-testid="itemDescription">Desc</span><h2>Head</h2>') == "Desc"
    assert name('<h3></h3><h4>Four</h4><h2>Two</h2>') == "Two"
    assert name('<a href="/x">Shop All</a><a href="/collections/y">A long category</a><a href="/p/z">Last Purchased The longest product</a>') == "The longest product"
    assert name('<i data-title="Data title"></i>') == "Data title" and name('<img alt="icon of tea"><img alt="Green tea box">') == "Green tea box"
    assert name('<p>$5 no</p><p>some plain text</p>') == "some plain text" and cards.name_of(Page('<div class="card" title="T"></div>'), 0) == "T"
    sku = lambda html: cards.sku_of(Page(f'<div class="card">{html}</div>'), 0)
    assert sku("<p>Item Number # ab-12</p>") == "AB-12" and sku('<i class="mpn">no. x-9</i>') == "NO" and sku('<i data-id="q1"></i><p>SKU 77</p>') == "Q1" and sku("<p>x</p>") == ""
    p = Page('<div><img src="/outer.png"><div class="card"><b>x</b></div></div>')
    assert cards.image_of(p, p.all("div")[1], U) == "https://s.example/outer.png"
    assert cards.strict_price_of(Page('<div class="card"><b>$9</b><span class="cost">from $4.00 to $3.00 / case</span></div>'), 0) == "$3.00/case"


def test_cards_leave_the_frame_and_wrappers(spark):
    card = '<div class="tile"><a href="/p/{0}">Tea number {0} green</a><img src="/{0}.png"><span>${0}.00</span></div>'
    html = '<nav><div class="tile"><a href="/p/none">Not a product at all</a><img src="/n.png"></div></nav><div class="tile-grid item">' + "".join(card.format(k) for k in range(3)) + card.format(1) + "</div>"
    got = cards.listing_cards(spark.createDataFrame([(1, U, html), (2, U, None), (3, None, "")], "page_id long, url string, html string")).collect()
    assert [(r.product_name, r.price, r.product_url) for r in sorted(got, key=lambda r: r.ord)] == [(f"Tea number {k} green", f"${k}.00", f"https://s.example/p/{k}") for k in range(3)]


def test_layouts_choose_the_best_table():
    poor = "<table><tr><th>Price</th><th>Qty</th><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    rich = "<table><tr><td>Item</td><td>Name</td></tr><tr><td>1</td><td>$2.00</td></tr><tr><td>2</td><td>b</td></tr></table>"
    found = layouts.layout_of(Page(poor + rich))
    assert found.confidence == 1.0 and len(found.rows) == 2 and layouts.layout_of(Page("<table><tr><th>x</th></tr></table>")) is None
    assert [layouts.meaning_of(x) for x in ("Qty Order", "ITEM-NO:", "Item #", "Unit Price", "Photo", "Colour", "UPC/EAN")] == ["qty", "sku", "sku", "price", "image", None, "upc"]
    assert layouts.layout_of(Page("<div><p>Quantity:</p><p>1 Each</p></div><div><p>a</p><p>b</p></div><div><p>a</p><p>b</p></div>")) is None


def test_detail_codes_by_every_way():
    code = lambda html: detail_page.Detail(Page(html), U).identifier()
    for html in ("<p>Item UPC: 012345678905</p>", "<p><b>EAN</b>: 012345678905 x</p>", "<div><b>Barcode nr</b></div><p>012345678905</p>", "<dt>UPC</dt><dd>0-12345-67890-5</dd>"):
        assert code(html)[0] == "012345678905" and code(html)[2] == "label", html
    assert code('<script>x = {"a": {"gtin": "4006381333931"}}</script>')[::2] == ("4006381333931", "script") and code("<p>nothing</p>") == ("", "", "")
    assert detail_page.valid_code("12345678 and 4-006381-333931") == "4006381333931" and detail_page.valid_code("11111111") == ""


def test_price_of_something_else(spark):
    html = "<h1>Tea</h1><p>Unit Price</p><p>$2.00 ea</p><p>1 EA = $2.50 EA</p>"
    r = detail_page.detail_fields(spark.createDataFrame([(1, U, html), (2, U, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].price, r[0].unit_price, r[0].pricing_unit) == ("$2.00", "$2.50", "EA") and r[1].product_name == "" and r[1].identifier_type == ""


def test_balanced_objects():
    assert enrichment.balanced_object('x "m": {"a": "}\\"", "b": {"c": 1}} y', '"m"') == '{"a": "}\\"", "b": {"c": 1}}'
    assert enrichment.balanced_object('"m": {"a"', '"m"') == "" and enrichment.balanced_object("none", '"m"') == ""


def test_targets_score_alike_in_both_forms(spark):
    rows = [("https://s.example/product/red-cup", "Details", "href", True, "order sku price case pack"), ("https://s.example/cart", "buy now", "data-url", False, "x"), ("https://s.example/p/12", "", "data-link", False, "item upc"), ("https://s.example/zz/abcdef?q=1", "t" * 101, "onclick_url", False, "")]
    df = spark.createDataFrame(rows, "url string, text string, source string, wraps boolean, around string")
    got = df.select(targets.target_score(*(F.col(c) for c in ("url", "text", "source", "wraps", "around"))).alias("s")).collect()
    assert [r.s for r in got] == [targets._plain_score((u, "a", t, s, w), around) for u, t, s, w, around in rows] == [12, -5, 4, 0]


def test_crawl_guards(spark):
    link = lambda to: f'<a rel="next" href="{to}">n</a>'
    pages = [(1, "https://a.example/", link("/2")), (2, "https://a.example/2", link("/")), (3, "https://b.example/", link("https://a.example/2")), (4, "https://c.example/", link("?page=2")), (5, "https://c.example/?page=2", link("?page=3")), (6, "https://c.example/?page=3", link("?page=4"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    starts = spark.createDataFrame([(1, "https://a.example/"), (2, "https://b.example/"), (3, "https://c.example/"), (4, "https://none.example/")], "crawl long, url string")
    got = {(r.crawl, r.page_num): r.stop_reason for r in crawl.visits(starts, df, most=2).collect()}
    assert got == {(1, 1): None, (1, 2): "navigation exhausted after page 2", (2, 1): "navigation exhausted after page 1", (3, 1): None, (3, 2): "max page cap reached (2)"}
    free = {(r.crawl, r.page_num): r.stop_reason for r in crawl.visits(starts.where("crawl = 3"), df, most=None).collect()}
    assert free[3, 3] == "page not stored: https://c.example/?page=4"


def test_url_forms():
    assert url.numbered_page("https://s.example/a?p=1&x=2", 3) == "https://s.example/a?p=3&x=2" and url.feed_bases("https://s.example/a/collections/b/products/c") == ["https://s.example/a/collections/b/products.json", "https://s.example/products.json"]
    found = url.rendered_variants("https://s.example/l/page/2?limit=10", 4)
    assert found[0] == "https://s.example/l/page/2?limit=10&page=4" and "https://s.example/l/page/2?limit=10&offset=30" in found and found[-1] == "https://s.example/l/page/4?limit=10" and len(found) <= 16


def test_models_see_no_scripts_and_bounded_texts():
    assert evidence.clean_html("<header>h</header><svg><g/></svg><p onclick='x' title='a\"b'>t &lt; u</p><noscript><p>n</p></noscript>") == '<p title="a&quot;b">t &lt; u</p>'
    page = Page("<table><tr><td>" + "long text " * 500 + "</td></tr></table>")
    assert max(map(len, evidence.listing_evidence(page, U).split(evidence.JOINT)[:1])) == evidence.ELEMENT_CHARS


def test_null_groups_have_price_modes(spark):
    rows = [(i, g, "n", "$1", "u") for i, g in enumerate(["x"] * 8 + [None] * 8)]
    got = quality.quality_report(spark.createDataFrame(rows, "ord int, g string, product_name string, price string, product_url string").withColumns({"sku": F.lit("s"), "upc": F.lit("")}), ["g"]).collect()
    assert len(got) == 2 and all(any("Price anomaly" in w for w in r.warnings) for r in got)


def test_scripts_of_many_products_keep_their_order(spark):
    many = json.dumps([{"@type": "Product", "name": f"N{k:04d}"} for k in range(1500)])
    html = f'<script type="application/ld+json">{many}</script><script type="application/ld+json">{{"@type":"Product","name":"last"}}</script>'
    df = spark.createDataFrame([(1, U, html)], "page_id long, url string, html string")
    got = structured.jsonld(df, dom.nodes(df)).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1501)) and got[-1].product_name == "last"


def test_registries(spark):
    pages = spark.createDataFrame([(1, U, '<script type="application/ld+json">{"@type":"Product","name":"Tea","sku":"1"}</script>'), (2, U, "<table><tr><th>Item</th><th>Name</th></tr><tr><td>I1</td><td>a</td></tr><tr><td>I2</td><td>b</td></tr></table>")], "page_id long, url string, html string")
    plug = registry.default_strategies()
    assert sorted((r.page_id, r.product_name, r.strategy_id) for r in plug.best(pages).collect()) == [(1, "Tea", 1), (2, "a", 2), (2, "b", 2)]
    plug.add(9, "mine")(lambda p: p.selectExpr("page_id", "'x' AS product_name"))
    assert plug.run(9, pages).first().strategy_name == "mine"
    with pytest.raises(ValueError):
        plug.add(9, "again")(lambda p: p)
    providers = registry.Providers()
    for name in ("one", "two"):
        providers.add(name, lambda products, name=name: products.selectExpr("ord", f"'{name} title' AS title"))
    products = spark.createDataFrame([(1,), (2,)], "ord int")
    routes = spark.createDataFrame([(1, "two", 0)], "ord int, provider string, position int")
    assert providers.candidates(products).count() == 4 and [tuple(r)[:3] for r in providers.candidates(products, routes).collect()] == [(1, "two title", "two")]
    links = spark.createDataFrame([(U,), ("https://none.example",)], "product_url string")
    assert registry.fetched(links, pages).count() == 2
    assert "page_nodes" in registry.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT tag, text FROM page_nodes('<p>a<b>c</b></p>')").collect()] == [("p", "a c"), ("b", "c")]
    assert spark.sql("SELECT code_digits('0-12345-67890-5') AS d, looks_like_product('https://a.b/p/x') AS p").first() == ("012345678905", True)
