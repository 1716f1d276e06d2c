"""Column functions on golden values."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import ids, money, pack, scoring, text, url


def check(spark, cases, f, names=("c",)):
    """f(columns) on each case's inputs gives its expectation, in one job."""
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, (x, _) in enumerate(cases)]
    n = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    got = {r.i: r.v for r in df.select("i", f(*(F.col(f"c{k}") for k in range(n))).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_text(spark):
    check(spark, [("  a \t b\n", "a b"), (None, ""), ("a b", "a b")], text.squeeze)
    check(spark, [("Tom &amp; Jerry\x07 x", "Tom & Jerry x"), (None, "")], text.clean_string)
    check(spark, [("<p>a<b>b</b></p><script>x()</script> c", "a b c")], text.strip_html)
    check(spark, [("nestle", "Nestle"), ("3M CO", "3M CO"), ("o'hara foods", "O'Hara Foods"), ("LONGNAME", "LONGNAME")], text.brand_case)
    check(spark, [("KRAFT dinner", "KRAFT"), ("", ""), ("Tootsie Roll Pops", "TOOTSIE ROLL")], text.title_brand)
    check(spark, [("SYS-1", "SYSCO"), ("K-9", "KRAFT"), ("x", "")], text.sku_brand)
    check(spark, [("Cups pack of 12", "12"), ("Cups 24 ct", "24"), ("Cups", "")], text.case_count)
    check(spark, [("![x](y) **A** [b](c)  d", "A b d")], text.clean_markdown)
    check(spark, [("Add to cart\nAB-12\nz", "AB-12"), ("two words\n", "")], text.card_sku)
    check(spark, [("Ab1cd XYZ ab", ["b1cd"]), ("abc abc", ["abc"])], text.match_tokens)
    assert_queries = [((("B", "N", "P", "C", "S")), ["B N P", "B N case C", "B N", "N P", "N case C", "B S N", "N", "B S"]), (("", "N", "", "", ""), ["N"]), (("", "", "", "", ""), [])]
    check(spark, assert_queries, text.lookup_queries)
    check(spark, [(("B", "N", "P", "6"), ["B N P", "B N", "N P", "N 6 count", "N"]), (("", "N", "", ""), ["N"])], text.retail_queries)


def test_money(spark):
    check(spark, [("1299", "$12.99"), ("1299.0", "$1,299.00"), ("999", "$999.00"), ("", ""), (None, ""), ("call us", "call us"), ("13.97", "$13.97")], money.money)
    check(spark, [(("1999", "2", "$"), "$19.99"), (("5", "0", "€"), "€5.00"), (("", "2", "$"), ""), (("1.5", "2", "$"), "$1.50"), (("250", None, None), "$2.50")], money.minor_unit_money)
    check(spark, [("was $ 1,200.50 now", "$1,200.50"), ("A$5", ""), ("none", "")], money.first_price)
    check(spark, [("1+ $5.00 10+ $3.50", "$3.50"), ("-", "")], money.lowest_tier)
    check(spark, [(("$1500.00", "$3.00", ""), True), (("$50.00", "$3.00", "EA"), True), (("$4.00", "$3.00", "EA"), False), (("", "", ""), False)], money.is_page_wide_price)


def test_identifiers(spark):
    check(spark, [("0 12345-67890 5", "012345678905"), ("12345", ""), ("abc", ""), (None, "")], ids.barcode)
    check(spark, [("12345670", "ean8"), ("012345678905", "upc"), ("1234567890123", "ean13"), ("12345678901234", "gtin14"), ("", ""), ("123456789", "barcode")], ids.barcode_kind)
    check(spark, [("036000291452", True), ("036000291453", False), ("12345670", True), ("4006381333931", True), ("00012345678905", True), ("111111111117", False), ("0", False), (None, False)], ids.has_valid_check_digit)
    check(spark, [("x 036000291453 y 0360-0029-1452", "036000291452"), ("none", "")], ids.first_valid)
    check(spark, [("00012345678905", "012345678905"), ("012345678905", "012345678905"), ("123", "")], ids.upc12)
    check(spark, [("UPC: 012345678905", "012345678905"), ("GTIN 00012345678905", "012345678905"), ("x", "")], ids.labelled_upc)
    check(spark, [("AB-12/3.4", True), ("ab_1", False), ("abc", False), ("btn-12", False), ("1", False), (None, False)], ids.is_catalog_sku)
    check(spark, [("A 1", True), ("x", False), ("123e4567-e89b-12d3-a456-426614174000", False)], ids.is_detail_sku)
    check(spark, [(("AB-1", "ab1"), True), (("AB-12", "xAB12x"), True), (("", "a"), False), (("a", "b"), False)], ids.same_sku)
    check(spark, [("0123 4567-8905", "012345678905"), ("12a45678", "")], ids.detail_upc)


PACKS = [
    ("4/1 GAL", ("4", "1 GAL", "GAL", "high", "compact_slash")), ("4/1GAL", ("4", "1 GAL", "GAL", "high", "compact_slash")), ("6/2.5LB", ("6", "2.5 LB", "LB", "high", "compact_slash")), ("12/32OZ", ("12", "32 OZ", "OZ", "high", "compact_slash")),
    ("1 GAL EA, 4/CS", ("4", "1 GAL", "GAL", "high", "eacs_split")), ("60/EA", ("60", "", "EA", "medium", "count_only_slash")), ("5.7 OZ/12PK", ("12", "5.7 OZ", "OZ", "high", "reversed_slash")), ("4 x 1 gal", ("4", "1 GAL", "GAL", "high", "cross_multiply")),
    ("4 × 6", ("4", "6", "", "medium", "cross_multiply")), ("4-1gal", ("4", "1 GAL", "GAL", "high", "dash_separator")), ("case of 12", ("12", "", "", "medium", "case_of")), ("24 per case", ("24", "", "", "medium", "per_case")), ("32.0 fl oz", ("", "32 FL OZ", "FL OZ", "low", "plain_size")), ("nothing", None), ("", None),
]


def test_packs(spark):
    fields = ["case_pack", "pack_size", "unit_measure", "pack_confidence", "pack_method"]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PACKS)], "i int, t string").select("i", pack.parse_pack(F.col("t")).alias("p"), pack.parse_pack(F.col("t"), strict_compat=True).alias("s")).collect()
    got = {r.i: r for r in df}
    for i, (t, want) in enumerate(PACKS):
        assert (tuple(got[i].p[f] for f in fields) if got[i].p else None) == want, t
    strict = {t: got[i].s.pack_method if got[i].s else None for i, (t, _) in enumerate(PACKS)}
    assert strict["4/1 GAL"] == "compact_slash" and strict["4/1GAL"] is None and strict["4-1gal"] is None


def test_pack_rows_and_titles(spark):
    df = spark.createDataFrame([(1, "", "", "Soap - blue, 4/1 GAL"), (2, "10 OZ", "12", "x"), (3, "", "6/EA", "x"), (4, "", "", "plain")], "ord int, pack_size string, case_pack string, product_name string")
    got = {r.ord: (r.pack_size, r.case_pack, r.pack_confidence, r.unit_measure) for r in pack.enrich_pack(df).collect()}
    assert got == {1: ("1 GAL", "4", "medium", "GAL"), 2: ("10 OZ", "12", "low", "OZ"), 3: ("", "6", "medium", "EA"), 4: ("", "", "", "")}
    check(spark, [("Gel - 16oz/3pk", ("16 OZ", "3", "16oz/3pk", 0.95)), ("Pods 4pk", ("", "4", "4pk", 0.75)), ("Pods 10 ct 4pk", ("10 CT", "4", "4pk", 0.8)), ("Wipes 75ct", ("75 CT", "", "75ct", 0.6)), ("none", None)], lambda c: pack.parse_title_abbreviation(c))


def test_errors_and_statuses(spark):
    check(spark, [("403 Forbidden", "blocked"), ("Read timed out. (read timeout=20)", "timeout"), ("dns failure", "network"), ("HTTP 500", "http_error"), ("oops", "runtime_error"), (None, "runtime_error")], scoring.error_category)
    check(spark, [("Verifying your connection...", True), ("please complete the CAPTCHA", True), ("A page", False), (None, False)], scoring.is_blocked_page)
    df = spark.createDataFrame([("", 5, 0.9, 0.8), ("", 5, 0.6, 0.9), ("", 0, 0.0, 0.0), ("x timed out", 5, 1.0, 1.0), ("boom", 0, 0.0, 0.0), ("", 2, 1.0, 1.0)], "e string, n int, c double, s double")
    assert [r[0] for r in df.select(scoring.benchmark_status(F.col("e"), F.col("n"), F.col("c"), F.col("s"))).collect()] == ["pass", "partial", "fail", "timeout", "error", "partial"]


def test_scores(spark):
    p = {"product_name": F.col("c0"), "brand": F.col("c1"), "sku": F.col("c2"), "pack_size": F.col("c3"), "case_pack": F.lit("")}
    c = {"title": F.col("c4"), "brand": F.col("c5"), "pack_size": F.col("c6")}
    cases = [
        (("Blue Dish Soap 16 oz", "Acme", "S-1", "16 oz", "blue dish soap 16 oz", "acme", "16 oz"), 98),
        (("Blue Soap", "Acme", "", "", "Green Towel", "Other", ""), 0),
        (("", "", "", "", "", "", ""), 0),
    ]
    check(spark, cases, lambda *_: scoring.candidate_score(p, c))
    df = spark.createDataFrame([(57,), (58,), (77,), (78,)], "s int")
    assert [tuple(r) for r in df.select(scoring.confidence(F.col("s")), scoring.confidence_color(F.col("s"))).collect()] == [("", ""), ("medium", "yellow"), ("medium", "yellow"), ("high", "green")]


def test_title_ratio_is_the_sequence_matchers(spark):
    import difflib

    pairs = [("abc def", "abd ef"), ("x" * 250 + "y", "y" + "x" * 250), ("", "a"), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(scoring.title_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


@pytest.mark.parametrize(
    "u,want",
    [("https://a.example/product/x", True), ("https://a.example/products/x", True), ("https://a.example/p/x", True), ("https://a.example/clear-bottle-24152", True), ("https://a.example/category/x", False), ("https://a.example/search?q=1", False), ("https://a.example/x.jpg", False), ("https://a.example/basket", False), ("", False)],
)
def test_product_urls(spark, u, want):
    check(spark, [(u, want)], url.is_product_url)


def test_urls(spark):
    check(spark, [("https://a.example/x//?q=1#f", "https://a.example/x?q=1"), ("https://a.example/", "https://a.example"), ("", "")], url.url_key)
    check(spark, [("https://a.example/p/blue-soap_16.html", "Blue Soap 16"), ("https://a.example/products/", "")], url.name_from_url)
    check(spark, [(("https://www.a.example/x", "https://shop.a.example/y"), True), (("https://a.example", "https://ba.example"), False)], url.same_site)
    check(spark, [(("../b?c", "https://a.example/x/y"), "https://a.example/b?c"), (("", "https://a.example"), "")], url.absolute_url)
    assert url.page_variants("https://a.example/l?pg=2&q=", 3) == ["https://a.example/l?pg=3&q="]
    assert url.page_variants("https://a.example/l/page/2/?start=20", 3, 20) == ["https://a.example/l/page/2/?start=20&page=3", "https://a.example/l/page/2/?start=40", "https://a.example/l/page/3/?start=20"]
    df = spark.createDataFrame([("Items 1-100 of 1254",), ("Page 1 of 3",), ("788 items",), ("nothing",)], "t string").select(url.pagination(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in df] == [(1254, 100, 13), (None, None, 3), (788, None, None), (None, None, None)]


def test_identity(spark):
    rows = [("012345678905", ""), ("00012345678905", ""), ("1234567890123", ""), ("", "10012345678902"), ("", ""), ("12345678", "12345678")]
    got = [r.r for r in spark.createDataFrame(rows, "u string, g string").select(ids.supplier_identity(F.col("u"), F.col("g")).alias("r")).collect()]
    assert [(r.upc_12, r.native_identifier_type, r.identifier_status, r.needs_resolution) for r in got] == [
        ("012345678905", "upc_12", "native_upc", "0"), ("012345678905", "gtin_14", "converted_padded_gtin14", "0"), ("", "gtin_13", "gtin_13", "1"), ("", "gtin_case", "missing_identifier", "1"), ("", "", "missing_identifier", "1"), ("", "gtin_case", "gtin_case", "1"),
    ]


def test_dates_are_plain(spark):
    assert spark.sql("select timestamp'2024-01-01' as t").first().t == datetime.datetime(2024, 1, 1)
