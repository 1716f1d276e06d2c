"""Relational operators against plain loops."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from shelfspark.operators import dedup, merge, quality
from shelfspark.schema import PRODUCT_FIELDS, conform, missing_as_empty, without_internal
from shelfspark.sources import nodes as dom
from shelfspark.sources import runs

COLS = ["product_url", "sku", "product_name", "brand", "price", "image_url"]


def random_rows(seed, n=300):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    return [(i, pick(["", "u1", "u2/", "u2", *[f"u{k}" for k in range(60)]]), pick(["", *[f"s{k}" for k in range(50)]]), pick(["", "A!", "a", *[f"n{k}" for k in range(20)]]), pick(["", "b"]), pick(["", "$1", "$2"]), pick(["", "i1", "i2"])) for i in range(n)]


def frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "ord int, " + ", ".join(f"{c} string" for c in COLS))
    return df.repartition(parts)


def loop(rows, keys, only_accepted=False):
    seen = [set() for _ in keys]
    out = []
    for r in rows:
        found = [k(dict(zip(["ord", *COLS], r, strict=True))) for k in keys]
        if only_accepted:
            if any(k and k in s for k, s in zip(found, seen, strict=True)):
                continue
            for k, s in zip(found, seen, strict=True):
                s.add(k)
            out.append(r[0])
            continue
        for k, s in zip(found, seen, strict=True):
            if k:
                if k in s:
                    break
                s.add(k)
        else:
            out.append(r[0])
    return out


def digits(x):
    return "".join(c for c in x if c.isdigit() or c == ".")


def identity(p):
    return p["product_name"].lower() and f"{p['product_name'].lower()}|{p['brand']}|{digits(p['price'])}"


def test_cascades_are_those_of_a_loop(spark):
    for seed in range(3):
        rows = random_rows(seed)
        got = sorted(r.ord for r in dedup.dedup_listing(frame(spark, rows)).collect())
        assert got == loop(rows, [lambda p: p["product_url"], lambda p: p["sku"], identity])
        got = sorted(r.ord for r in dedup.dedup_browser(frame(spark, rows)).collect())
        assert got == loop(rows, [lambda p: p["product_url"], identity, lambda p: p["image_url"] and p["product_name"] and f"{p['image_url']}|{p['product_name'].lower()}"])


def test_greedy_is_sequential_in_effect(spark):
    name = lambda s: "".join(c for c in s.lower() if c.isalnum() or c == " ").strip()
    for seed in range(3):
        rows = random_rows(10 + seed, 150)
        got = sorted(r.ord for r in dedup.dedup_greedy(frame(spark, rows)).collect())
        assert got == loop(rows, [lambda p: p["product_url"], lambda p: p["sku"], lambda p: name(p["product_name"]) and f"{name(p['product_name'])}::{p['brand']}"], only_accepted=True)


def test_merge_fills_from_later_rows(spark):
    rows = [(1, "u", "", "Name", "", "", ""), (2, "u/", "s", "Other", "b", "", ""), (3, "", "", "", "", "", ""), (4, "", "s2", "", "", "$1", "")]
    got = sorted(tuple(r) for r in dedup.dedup_merge(frame(spark, rows)).collect())
    assert got == [(1, "u", "s", "Name", "b", "", ""), (3, "", "", "", "", "", ""), (4, "", "s2", "", "", "$1", "")]


def test_empty_frames(spark):
    empty = frame(spark, [])
    for f in (dedup.dedup_listing, dedup.dedup_browser, dedup.dedup_key, dedup.dedup_merge, dedup.dedup_greedy):
        assert f(empty).count() == 0
    assert quality.quality_report(empty.withColumns({"upc": F.lit("")}), ["brand"]).count() == 0


def test_quality_rules(spark):
    def report(rows, **more):
        names = ["ord", "g", "product_name", "price", "sku", "upc", "product_url", "image_url"]
        df = spark.createDataFrame([(i, "g", *(r.get(c, "") for c in names[2:])) for i, r in enumerate(rows)], "ord int, g string, " + ", ".join(f"{c} string" for c in names[2:]))
        return quality.quality_report(df, ["g"], **more).first()

    r = report([{"product_name": f"P{i}", "price": f"${i}", "product_url": f"u{i}"} for i in range(3)])
    assert r.score == 0.85 and "UPC" in r.warnings[0]
    r = report([{"product_name": "Your Shopping Cart", "product_url": "/cart"} for _ in range(3)])
    assert len(r.warnings) == 3 and r.score == 0.15
    r = report([{"product_name": f"P{i}", "upc": str(i), "product_url": "u"} for i in range(20)], expected_products=F.lit(205))
    assert any("captured 20/205" in w for w in r.warnings) and r.score == 0.8
    r = report([{"product_name": f"P{i}", "price": "$1", "upc": "1", "product_url": "u"} for i in range(7)], expected_pages=F.lit(5), pages_visited=F.lit(2), stop_reason=F.lit("limit"))
    assert [w[:10] for w in r.warnings] == ["Price anom", "Pagination", "Stop reaso"] and r.score == 0.45


def test_enrichment_sides(spark):
    a = spark.createDataFrame([(1, "u", "A", ""), (2, "", "B", ""), (3, "v", "", "9")], "ord int, product_url string, product_name string, upc string")
    b = spark.createDataFrame([(1, "u", "X", "1"), (2, "u", "Y", "2"), (3, "v", "Z", "3"), (4, "", "no", "no")], "ord int, product_url string, product_name string, upc string")
    pick = lambda df: sorted(tuple(r) for r in df.select("ord", "product_name", "upc").collect())
    assert pick(merge.enrich_detail_wins(a, b)) == [(1, "X", "1"), (2, "B", ""), (3, "Z", "3")]
    assert pick(merge.backfill_listing_wins(a, b)) == [(1, "A", "1"), (2, "B", ""), (3, "Z", "9")]
    assert pick(merge.merge_from_model(a, b)) == [(1, "A", "1"), (2, "B", ""), (3, "Z", "3")]
    assert [r.upc_source for r in merge.backfill_listing_wins(a, b).orderBy("ord").collect()] == ["detail_upc", "", ""]


def test_budget_and_ranks(spark):
    df = spark.createDataFrame([(i, "g", 5 - i % 3, i % 2 == 0) for i in range(10)], "ord int, g string, s int, need boolean")
    got = {r.ord: r.lookup_status for r in merge.within_budget(df, F.col("s"), F.col("need"), 3, ["g"]).collect()}
    assert [i for i in got if got[i] == "looked_up"] == sorted([0, 4, 6]) or sorted(i for i in got if got[i] == "looked_up") == [0, 4, 6]
    assert all(got[i] == "not_needed" for i in (1, 3, 5, 7, 9)) and got[2] == got[8] == "external_lookup_skipped_budget"


def test_node_intervals(spark):
    html = "<body><ul><li>one<li>two <b>bold</ul><p>para<p>next<br>line<nav><a href=x>link</a></nav><table><tr><td>a<td>b<tr><td>c</table></body>"
    n, pieces = dom.parse(html)
    by = lambda t: [" ".join(pieces[slice(*x["said"])]) for x in n if x["tag"] == t]
    assert by("li") == ["one", "two bold"] and by("p") == ["para", "next line link a b c"] or by("p")[0] == "para"
    assert by("td") == ["a", "b", "c"] and [x["n_children"] for x in n if x["tag"] == "tr"] == [2, 1]
    for x in n:
        if x["parent"] is not None:
            p = n[x["parent"]]
            assert p["pre"] < x["pre"] and x["post"] < p["post"]
    df = dom.nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    assert {r.tag for r in dom.inside(df, dom.in_chrome()).collect()} == {"nav", "a"}
    assert "a" not in {r.tag for r in dom.outside(df, dom.in_chrome()).collect()}


def test_workbook_and_conforming(spark):
    df = spark.createDataFrame([(2, "B & <b>", None, "x"), (1, "A", "$1", "y")], "ord int, product_name string, price string, _hidden string")
    assert without_internal(df).columns == ["ord", "product_name", "price"] and missing_as_empty(df).where("price = ''").count() == 1
    rows = conform(df).orderBy("ord").collect()
    assert rows[0].product_name == "A" and rows[1].price == "" and len(rows[0]) == len(PRODUCT_FIELDS) + 1
    z = zipfile.ZipFile(io.BytesIO(runs.workbook(df, {"Rows": 2})))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "B &amp; &lt;b&gt;" in sheet and sheet.index(">A<") < sheet.index("B &amp;") and 'state="frozen"' in sheet and "<autoFilter" in sheet


def test_items_by_run_and_targets(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run_id int, product_name string")
    runs.save_items(items, str(tmp_path / "items"))
    runs.save_items(items.where("run_id = 2"), str(tmp_path / "items"))
    assert runs.read_items(spark, str(tmp_path / "items"), 2).count() == 2
    (tmp_path / "t.csv").write_text("﻿label,url,segment,notes\nA,a.example, Food ,\nB,,x,\nC,https://c.example,Toys,n\n", encoding="utf-8")
    t = runs.read_targets(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in t.orderBy("url").collect()] == [("A", "https://a.example", "Food", ""), ("C", "https://c.example", "Toys", "n")]
    assert runs.choose_targets(t, ["food"]).count() == 1


def test_pack_titles_and_pagination_run_over_all_of_part(spark, tmp_path):
    from shelfspark.plans.queries import queries

    spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 61)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.ord: tuple(r)[1:] for r in queries()["q_pack_title"](spark, str(tmp_path)).collect()}
    # the title is cut at the comma of '1 GAL EA, n/CS': its first part has the size alone
    assert sorted(got) == list(range(1, 61)) and {got[k] for k in range(10, 61, 12)} == {("", "1 GAL", "low", "title:plain_size")}
    pages = {r.ord: tuple(r)[1:] for r in queries()["q_pagination"](spark, str(tmp_path)).collect()}
    assert pages == {k: (k, 10, -(-k // 10)) for k in range(1, 61)}


def test_payloads_count_products_only_and_give_their_links(spark):
    import json

    from shelfspark.functions import url
    from shelfspark.operators import payloads

    media = [{"id": f"m{k}", "url": f"/i/{k}.jpg"} for k in range(payloads.LIMIT + 5)]
    many = [{"name": f"N{k}", "sku": f"s{k}"} for k in range(payloads.LIMIT + 5)]
    body = {"media": media, "items": [{"name": "Tea", "url": "/product/tea"}, {"next": "/p/cup", "bad": "http://[", "about": "/about"}], "urls": ["/p/in-a-list"]}
    df = spark.createDataFrame([(1, "https://b.example", json.dumps(body)), (2, "https://b.example", json.dumps(many))], "page_id long, url string, body string")
    assert payloads.walk_payloads(df).where("page_id = 2").count() == len(many)  # no cap but the one that is asked for
    got = payloads.walk_payloads(df, payloads.LIMIT).select("page_id", "product_name").collect()
    assert [r.product_name for r in got if r.page_id == 1] == ["Tea"] and {r.product_name for r in got if r.page_id == 2} == {f"N{k}" for k in range(payloads.LIMIT)}
    assert {(r.page_id, r.product_url) for r in payloads.payload_links(df).collect()} == {(1, "https://b.example/product/tea"), (1, "https://b.example/p/cup")}
    urls = ["", " ", "https://a.b/p/x", "https://a.b/x.html", "https://a.b/x/y.html", "https://a.b/blue-towel-item77?x=1", "https://a.b/short-1", "https://a.b/p/i.PNG", "/cart/p/1", "nothing"]
    cols = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url.is_product_url(F.col("u")).alias("ok")).collect()
    assert all(r.ok == url.looks_like_product(r.u) for r in cols)


def test_extraction_over_whole_tables(spark, tmp_path):
    from shelfspark.plans import extraction
    from shelfspark.plans.queries import queries

    pages = [(r[0], *r[1:]) for r in extraction.PAGES] + [(10 + r[0], *r[1:]) for r in extraction.DETAILS]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    part = [(k, f"blue towel {k}", f"Brand#{k % 5}", "PROMO TIN", k) for k in range(1, 41)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: queries()[name](spark, str(tmp_path)).collect()
    # the inline rows stand in the table: what they gave there, they give here
    for name in ("structured_tiers", "page_classes"):
        assert {tuple(r) for r in run(f"q_{name}")} <= {tuple(r) for r in run(f"q_all_{name}")}, name
    assert {r.page_id for r in run("q_all_page_classes")} == {r[0] for r in pages}
    assert {(r.page_id, r.product_url) for r in run("q_all_cards")} >= {(14, "https://d.example/product/tea-box"), (14, "https://d.example/product/cup")}
    for name, n in {"feed_variants": 80, "payload_walk": 40, "model_rows": 40, "link_rows": 40, "category_names": 40}.items():
        assert len(run(f"q_all_{name}")) == n, name


def test_markdown_has_no_cap_on_cards(spark):
    from shelfspark.operators import payloads

    body = "".join(f"{k}. [![Card](/i.jpg)](/item-{k})\n" for k in range(7))
    df = spark.createDataFrame([(1, "https://m.example/", body), (2, "https://m.example/", None), (3, "https://m.example/", "none")], "page_id long, url string, body string")
    cards = payloads.markdown_cards(df)
    # a text of more cards than the former cap takes minutes here: the plan must hold no cap
    assert "100000" not in cards._jdf.queryExecution().analyzed().toString() and cards.count() == 7
