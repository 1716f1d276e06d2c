"""Page operators at size: one pass a page, rows of several pages to a batch, plain markup without the tolerant parser."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import cards, crawl, structured, targets
from shelfspark.sources import dom
from shelfspark.sources import nodes as tree

U = "https://s.example/list"
LD = '<script type="application/ld+json">{"@type":"Product","name":"N%d","url":"/p/%d"}</script>'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jsonld_takes_one_pass_and_no_join(spark):
    df = spark.createDataFrame([(k, f"https://h{k}.example/", (LD % (k, k)) * 2 + "<p>x") for k in range(50)], "page_id long, url string, html string")
    got = structured.jsonld(df, tree.nodes(df))
    assert not any(x in plan_of(got) for x in ("Join", "Window", "Exchange"))
    assert sorted((r.page_id, r.ord, r.product_name, r.product_url) for r in got.collect()) == [(k, o, f"N{k}", f"https://h{k}.example/p/{k}") for k in range(50) for o in range(2)]


def test_rows_of_several_pages_share_a_batch(spark):
    df = spark.createDataFrame([(k, U, "<p>x</p>") for k in range(40)], "page_id long, url string, html string").coalesce(1)
    made = []
    fake = type("Pages", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, kinds: made.append(run)})()
    dom.per_page(fake, "said string", lambda page, url: iter([(page.text(),)]))
    tree.nodes(fake)
    for run in made:
        assert len(list(run(iter(df.toArrow().to_batches())))) == 1


def test_plain_markup_gives_the_tolerant_parsers_tree():
    def tolerant(html):
        t = tree._Tree()
        t.feed(html)
        t.close()
        t._close_to(0)
        return t

    bits = ['<p>', "</P>", '<a href="x&amp;y" B>', "<a href='q'>", "<br/>", '<img src="a>b"/>', "t", "&amp;", "& ", "<", "<script>", "</script>", "<style>", "</style>", "<!-- x -->", "<!DOCTYPE html>", "<li>", "<td>", "<tr>", "<a b=c>", '<a href="1"b="2">', "<script/>", "é", '<x a="1" a="">']
    pick, plain = random.Random(1), 0
    for _ in range(4000):
        html = "".join(pick.choice(bits) for _ in range(pick.randint(1, 9)))
        if (found := tree._plain(html)) is not None:
            found._close_to(0)
            plain += 1
            assert (found.nodes, found.pieces) == (tolerant(html).nodes, tolerant(html).pieces), html
    assert plain > 1000


@pytest.mark.parametrize(("href", "full"), [("/p/1", "https://s.example/p/1"), ("/p/../q", "https://s.example/q"), ("//h/x", "https://h/x"), ("/p?", "https://s.example/p"), ("/p?a=1#f", "https://s.example/p?a=1#f"), (" /a/./b ", "https://s.example/a/b"), ("x", "https://s.example/x")])
def test_links_resolve_alike_with_and_without_general_rules(href, full):
    assert dom.resolve(U, href) == full


def test_a_crawls_result_reads_stored_steps_and_joins_nothing(spark):
    page = '<p>Items 1-2 of 6</p><link rel="next" href="?page=2">'
    rows = [(1, "https://a.example/list", page), (2, "https://a.example/list?page=2", "x"), (3, "https://a.example/list?page=3", "y"), (4, "https://b.example/list", page), (9, "https://b.example/list", "later")]
    stored = spark.createDataFrame(rows, "page_id long, url string, html string")
    starts = spark.createDataFrame([(1, "https://a.example/list"), (2, "https://b.example/list"), (3, "https://c.example/none")], "crawl long, url string")
    got = crawl.visits(starts, stored)
    assert not any(x in plan_of(got) for x in ("Join", "Exchange", "MapInArrow"))
    assert sorted((r.crawl, r.page_num, r.page_id, r.stop_reason) for r in got.collect()) == [
        (1, 1, 1, None), (1, 2, 2, None), (1, 3, 3, "all 3 expected page(s) visited; no further navigation found"), (2, 1, 4, "page not stored: https://b.example/list?page=2"),
    ]


def test_rows_of_visited_pages_are_not_broadcast(spark):
    stored = spark.createDataFrame([(k, f"{U}?page={k}", LD % (k, k)) for k in range(1, 4)], "page_id long, url string, html string")
    visited = spark.createDataFrame([(1, k, k) for k in range(1, 4)], "crawl long, page_num int, page_id long")
    visited = visited.unionByName(visited.where("page_id > 9"))
    got = crawl.crawl_products(visited, stored, structured.jsonld, [F.col("product_url")])
    assert "Broadcast" not in plan_of(got)
    assert sorted((r.crawl, r.page_num, r.product_name) for r in got.collect()) == [(1, 1, "N1"), (1, 2, "N2"), (1, 3, "N3")]


def test_links_are_taken_where_pages_stand(spark):
    """Pages aren't moved to their visits: the links are, and only those of visited pages stay, each where it is met first."""
    link = '<ul class="pagination"><li><a href="?page=2">Next</a></li></ul><img src="/x.png"><a href="/product/%d">x</a><a href="/cart">y</a><a href="/product/7">z</a>'
    stored = spark.createDataFrame([(k, f"{U}?page={k}", link % k) for k in range(1, 5)], "page_id long, url string, html string")
    visited = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 3)], "crawl long, page_num int, page_id long")
    got = crawl.crawl_links(visited, stored)
    plan = plan_of(got)
    assert "LeftSemi" not in plan and "Broadcast" not in plan
    at = lambda k: f"https://s.example/product/{k}"
    assert sorted((r.crawl, r.page_num, r.product_url) for r in got.collect()) == [(1, 1, at(1)), (1, 1, at(7)), (1, 2, at(3)), (2, 1, at(3)), (2, 1, at(7))]


def test_a_pages_links_are_resolved_once(monkeypatch):
    page = dom.Page('<nav><a href="/product/1">a</a></nav><a href="/x/2">b</a><a href="https://t.example/product/3">c</a><a href="/x/2">d</a>')
    calls, resolve = [], targets.resolve
    monkeypatch.setattr(targets, "resolve", lambda base, href: calls.append(href) or resolve(base, href))
    assert [(n, [u for u, _ in found]) for n, found in targets.link_passes(page, U)][2:] == [(1, []), (2, ["https://s.example/product/1"]), (3, [])]
    assert len(calls) == 4


@pytest.mark.parametrize("base", ["https://s.example", U, f"{U}?page=1", "https://s.example/a;b", "https://s.example/a/../b#c", "http://S.example:8/%41//b/", "ftp://s.example/x"])
@pytest.mark.parametrize("href", ["?page=2", "?", "?a=1&b=%20", "?a#f", "?a b", "??"])
def test_queries_alone_resolve_as_by_general_rules(base, href):
    assert dom.resolve(base, href) == urljoin(base, href)


def test_a_cards_name_and_shape_are_worked_out_once(monkeypatch):
    card = '<div class="product-card"><img src="/i/%d.jpg"><h3>Nice bowl number %d</h3><span class="price">$%d.00</span><a href="/p/%d-bowl">see it</a><p>in stock now</p></div>'
    page = dom.Page("<title>Nice bowl</title>" + "".join(card % (k, k, k, k) for k in range(1, 5)))
    calls, sources = [], cards.name_sources
    monkeypatch.setattr(cards, "name_sources", lambda p, i: calls.append(i) or sources(p, i))
    found = cards.cards_of(page, U)
    assert [cards.name_of(page, i) for i in found] == [f"Nice bowl number {k}" for k in range(1, 5)]
    assert len(calls) == len(set(calls)) == 4
