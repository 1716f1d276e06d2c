"""Scores: how well a candidate fits a product, how strong a row is, what goes wrong in a run."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import word_key

GREEN, YELLOW = 78, 58
_SIZE = r"(?i)(\d+(?:\.\d+)?)\s*(fl oz|oz|lbs|lb|kg|g|ml|l|ct|gal|qt|pt)\b"
_SIZE_COMPAT = r"(?i)(\d+(?:\.\d+)?)\s*(oz|fl oz|lb|lbs|g|kg|ml|l|ct)"
_CASE = r"(?i)\b(?:case of|pack of|case pack|pk|pack|x)\s*(\d+)\b"
_CASE_AFTER = r"(?i)\b(\d+)\s*(?:pk|pack|ct)\b"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def either(*cs: Column) -> Column:
    """The first text that isn't missing, else ''."""
    return F.coalesce(*(F.nullif(_text(c), F.lit("")) for c in cs), F.lit(""))


def size_signal(c: Column, strict_compat: bool = False) -> Column:
    p = _SIZE_COMPAT if strict_compat else _SIZE
    return F.when(_text(c).rlike(p), F.concat(F.regexp_extract(_text(c), p, 1), F.lit(" "), F.regexp_replace(F.upper(F.regexp_extract(_text(c), p, 2)), "LBS", "LB"))).otherwise("")


def case_signal(c: Column) -> Column:
    return either(F.regexp_extract(_text(c), _CASE, 1), F.regexp_extract(_text(c), _CASE_AFTER, 1))


def brand_score(p: Column, c: Column) -> Column:
    return F.when((p == "") | (c == ""), 0).when(p == c, 30).when(F.contains(c, p) | F.contains(p, c), 18).otherwise(-25)


def size_score(p: Column, c: Column) -> Column:
    return F.when(p == "", 0).when(c == "", -8).when(p == c, 22).otherwise(-18)


def case_score(p: Column, c: Column) -> Column:
    return F.when(p == "", 0).when(c == "", -4).when(p == c, 12).otherwise(-12)


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters by longest common blocks; no column expression computes it."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def _words(key: Column) -> Column:
    """The distinct words of at least two characters of a word key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda x: F.length(x) >= 2))


def product_features(p: dict[str, Column]) -> Column:
    """What a product (product_name, brand, sku, unit_size, pack_size, case_pack) is scored by; once a product, before candidates meet it."""
    get = lambda k: _text(p[k]) if k in p else F.lit("")
    name = word_key(get("product_name"))
    return F.struct(
        name.alias("name"), _words(name).alias("words"), word_key(get("brand")).alias("brand"), word_key(size_signal(either(get("unit_size"), get("pack_size"), get("product_name")))).alias("size"),
        either(F.trim(get("case_pack")), case_signal(get("product_name"))).alias("case"), word_key(get("sku")).alias("sku"),
    )


def candidate_features(c: dict[str, Column]) -> Column:
    """The same of a candidate (title, brand, pack_size, case_pack)."""
    get = lambda k: _text(c[k]) if k in c else F.lit("")
    title, pack = word_key(get("title")), either(get("pack_size"), get("title"))
    return F.struct(title.alias("name"), _words(title).alias("words"), word_key(get("brand")).alias("brand"), word_key(size_signal(pack)).alias("size"), either(F.trim(get("case_pack")), case_signal(pack)).alias("case"))


def feature_score(p: Column, c: Column, fuzzy: bool = True) -> Column:
    """0 to 100 for a product's and a candidate's features.

    Without `fuzzy` the title counts by shared words only, and all of it stays in the JVM.
    """
    ratio = title_ratio(p["name"], c["name"]) if fuzzy else F.lit(0.5)
    shared = F.size(F.array_intersect(p["words"], c["words"]))
    more = F.when(shared >= 4, 8).when(shared >= 2, 4).otherwise(0)
    both = (p["name"] != "") & (c["name"] != "")
    title = F.when(both, F.bround(ratio * 38).cast("int") + more - F.when((ratio < 0.45) & (shared < 2), 20).otherwise(0)).otherwise(0)
    b = brand_score(p["brand"], c["brand"])
    total = b + title + size_score(p["size"], c["size"]) + case_score(p["case"], c["case"]) + F.when((p["sku"] != "") & F.contains(c["name"], p["sku"]), 8).otherwise(0)
    total = total - F.when(b == -25, 10).otherwise(0) - F.when(both & (shared == 0), 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def candidate_score(product: dict[str, Column], candidate: dict[str, Column], fuzzy: bool = True) -> Column:
    """`feature_score` of one row that holds both."""
    return feature_score(product_features(product), candidate_features(candidate), fuzzy)


def confidence(score: Column) -> Column:
    """high from 78, medium from 58, else ''."""
    return F.when(score >= GREEN, "high").when(score >= YELLOW, "medium").otherwise("")


def confidence_color(score: Column) -> Column:
    return F.when(score >= GREEN, "green").when(score >= YELLOW, "yellow").otherwise("")


def row_strength(p: dict[str, Column]) -> Column:
    """0 to 9: how much a row tells about its product."""
    has = lambda c: F.trim(c) != ""
    name = F.trim(_text(p["product_name"]))
    points = [(has(_text(p["brand"])), 3), (has(either(p["unit_size"], p["pack_size"])), 2), (has(_text(p["case_pack"])), 1), (F.length(name) >= 12, 2), (has(_text(p["sku"])), 1)]
    total = F.lit(0)
    for ok, n in points:
        total = total + F.when(ok, n).otherwise(0)
    return total


# Words of confectionery titles, and the providers asked for each group of rows, in order.
CANDY_WORDS = ["candy", "gum", "taffy", "tootsie", "whoppers", "smarties", "wafers", "bar", "lollipop", "mint", "snack", "theater box", "soda"]
ROUTES = {
    "consumer_candy_strong": ["upcdatabase", "go_upc", "open_food_facts", "upcitemdb"],
    "consumer_candy_weak": ["upcdatabase", "go_upc", "open_food_facts"],
    "strong_identity": ["upcitemdb", "upcdatabase", "open_food_facts", "go_upc"],
    "partial_identity": ["upcdatabase", "upcitemdb", "go_upc", "open_food_facts"],
    "weak_identity": ["upcdatabase", "go_upc"],
    "too_weak_to_query": [],
}


def row_group(p: dict[str, Column]) -> Column:
    """Which group of ROUTES a row belongs to."""
    name, brand, sku, unit = (F.trim(_text(p[c])) for c in ("product_name", "brand", "sku", "unit_size"))
    title = F.lower(_text(p["product_name"]))
    candy = F.greatest(*(F.contains(title, F.lit(w)) for w in CANDY_WORDS))
    weak = (F.length(name) < 8) & ~((name != "") & ((brand != "") | (sku != ""))) & (row_strength(p) < 3)
    sized = F.trim(either(p["unit_size"], p["pack_size"])) != ""
    return (
        F.when(weak, "too_weak_to_query").when(candy & (brand != "") & (unit != ""), "consumer_candy_strong").when(candy, "consumer_candy_weak")
        .when((brand != "") & sized, "strong_identity").when((brand != "") | (sku != ""), "partial_identity").otherwise("weak_identity")
    )


def detail_features(row: dict[str, Column]) -> Column:
    """What a row tells about which product it is: folded item number, bare URL, words, whether it has an identifier."""
    from .text import match_tokens

    return F.struct(
        F.lower(F.regexp_replace(_text(row["sku"]), "(?i)[^a-z0-9]", "")).alias("sku"), F.regexp_replace(_text(row["product_url"]), "/+$", "").alias("url"),
        match_tokens(_text(row["product_name"])).alias("words"), (either(row["upc"], row["ean"], row["gtin"]) != "").alias("coded"),
    )


def detail_match(listing: Column, detail: Column) -> Column:
    """How well a detail row fits a listing row: item number 80, URL 60, shared words up to 30, an identifier 10."""
    a, b = listing["sku"], detail["sku"]
    same = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    urls = (listing["url"] != "") & (listing["url"] == detail["url"])
    shared = F.size(F.array_intersect(listing["words"], detail["words"]))
    return F.when(same, 80).otherwise(0) + F.when(urls, 60).otherwise(0) + F.least(F.lit(30), shared * 5) + F.when(detail["coded"], 10).otherwise(0)


# Words of error texts, in the order that they are looked for.
ERROR_WORDS = {
    "timeout": ["timed out", "timeout", "read timed out"],
    "blocked": ["403", "401", "captcha", "access denied", "forbidden", "blocked", "checking your browser", "are you a robot", "robot"],
    "network": ["name resolution", "getaddrinfo", "connection", "dns", "ssl", "proxy"],
}
ERROR_WARNINGS = {
    "timeout": "The site did not finish within the configured timeout.",
    "blocked": "The site appears to block automated access or requires a browser/login session.",
    "network": "The site could not be reached reliably from this machine.",
    "http_error": "The site returned an HTTP error before extraction could run.",
    "runtime_error": "The scraper hit an unexpected runtime error.",
}
BLOCKED_PHRASES = ["verifying your connection", "checking your browser", "captcha", "access denied", "are you a robot", "too many requests"]


def error_category(error: Column) -> Column:
    from .url import holds_any

    low, out = F.lower(_text(error)), F
    for i, (name, words) in enumerate(ERROR_WORDS.items()):
        out = (F if i == 0 else out).when(holds_any(low, words), name)
    return out.when(low.rlike(r"\b(4\d\d|5\d\d)\b"), "http_error").otherwise("runtime_error")


def is_blocked_page(text: Column) -> Column:
    from .url import holds_any

    return holds_any(F.lower(_text(text)), BLOCKED_PHRASES)


def error_report(error: Column, stage: Column | None = None) -> Column:
    """score 0, the category, the message's first 500 characters and warnings."""
    kind = error_category(error)
    said = F.create_map(*[F.lit(x) for k, v in ERROR_WARNINGS.items() for x in (k, v)])[kind]
    warnings = F.array(said) if stage is None else F.when(_text(stage) != "", F.array(said, F.concat(F.lit("Failure stage: "), stage, F.lit(".")))).otherwise(F.array(said))
    return F.struct(F.lit(0.0).alias("score"), kind.alias("error_category"), F.substring(F.trim(either(error, F.lit("Unknown error."))), 1, 500).alias("error_message"), warnings.alias("warnings"))


def benchmark_status(error: Column, rows: Column, name_coverage: Column, score: Column) -> Column:
    """timeout, blocked, error, fail, pass or partial."""
    kind = error_category(error)
    return (
        F.when((_text(error) != "") & kind.isin("timeout", "blocked"), kind).when(_text(error) != "", "error").when(rows == 0, "fail")
        .when((rows >= 3) & (name_coverage >= 0.7) & (score >= 0.65), "pass").otherwise("partial")
    )


# Words of links that lead to catalogs, and away from them.
CATALOG_WORDS = [
    "shop", "catalog", "category", "categories", "collections", "products", "department", "departments", "supplies", "wholesale", "store", "all",
    "restaurant", "equipment", "office", "industrial", "grocery", "beauty",
]
OTHER_WORDS = [
    "account", "login", "signin", "register", "cart", "checkout", "wishlist", "blog", "about", "contact", "privacy", "terms", "careers",
    "locations", "support", "help", "track", "order-status", "gift-card",
]


def catalog_link_score(text: Column, href: Column) -> Column:
    from .url import holds_any, path

    both = F.lower(F.concat_ws(" ", text, path(href)))
    total = F.lit(0)
    for w in CATALOG_WORDS:
        total = total + F.when(F.contains(both, F.lit(w)), 2).otherwise(0)
    total = total + F.when(both.rlike(r"/(c|cat|category|categories|collections|shop|products?)(/|$)"), 5).otherwise(0) + F.when(F.contains(both, F.lit("all products")) | F.contains(both, F.lit("shop all")), 6).otherwise(0)
    return F.when(holds_any(both, OTHER_WORDS), -10).otherwise(total - F.when(path(href).isin("", "/"), 3).otherwise(0))


# --- retail search results ----------------------------------------------------------------------------------------
# Words that make a search result less likely to be the product.
RESULT_NOISE = [(-10, ["pack of 3", "pack of 6", "bundle", "variety pack"]), (-8, ["sold and shipped by", "marketplace seller", "+$", "shipping"]), (-25, ["/browse/", "/c/kp/"])]
RETAIL_ACCEPT = GREEN


def result_noise(title: Column, description: Column, url: Column) -> Column:
    """Points off a search result for bundles, marketplace offers and pages of several products."""
    from .url import holds_any

    said = F.lower(F.concat_ws(" ", *(_text(c) for c in (title, description, url))))
    return sum((F.when(holds_any(said, words), n).otherwise(0) for n, words in RESULT_NOISE), F.lit(0))


def search_candidate(title: Column, description: Column, url: Column, site: Column) -> Column:
    """A search result as a candidate: marks cut from the title, the size from title and description."""
    size = r"(?i)(\d+(?:\.\d+)?)\s*(oz|fl oz|lb|g|ct)"
    both = F.concat_ws(" ", _text(title), _text(description))
    return F.struct(
        F.regexp_replace(_text(title), "<<<.*?>>>", " ").alias("title"), F.lit("").alias("brand"), F.when(both.rlike(size), F.concat_ws(" ", F.regexp_extract(both, size, 1), F.upper(F.regexp_extract(both, size, 2)))).otherwise("").alias("pack_size"),
        _text(url).alias("source_url"), _text(site).alias("source_site"), _text(description).alias("description"),
    )


# Titles of error pages.
ERROR_TITLES = ["oops.", "404", "page not found", "not found", "access denied"]


def valid_detail(detail: dict[str, Column]) -> Column:
    """is_valid and reason of a detail row: an error page's title, a logo without product fields or no field at all is none."""
    name, sku, price, upc = (F.trim(_text(detail[c])) for c in ("product_name", "sku", "price", "upc"))
    bare = (sku == "") & (price == "") & (upc == "")
    reason = (
        F.when(F.lower(name).isin(ERROR_TITLES), F.concat(F.lit("error title: "), name)).when(F.contains(F.lower(_text(detail["image_url"])), F.lit("logo")) & bare, "site-level title without product fields")
        .when((name == "") & bare, "no trusted product fields").otherwise("ok")
    )
    return F.struct((reason == "ok").alias("is_valid"), reason.alias("reason"))


def wants_supplement(rows: Column, expected: Column, mode: str = "auto") -> Column:
    """Whether a run's rows want those of another extractor: always, never, or with fewer than five or half of those expected."""
    if mode in ("0", "off", "disabled", "none", "never"):
        return F.lit(False)
    if mode in ("supplement", "always"):
        return F.lit(True)
    return (rows < 5) | F.coalesce((expected > 0) & (rows < expected * 0.5), F.lit(False))


def wants_model(has_markdown: Column, useful_rows: Column, mode: str = "auto") -> Column:
    """Whether a hosted page wants a model's reading: there is markdown and fewer than three useful rows were found."""
    if mode in ("0", "off", "disabled", "none", "never"):
        return F.lit(False)
    return has_markdown & (F.lit(mode in ("1", "true", "yes", "on", "always")) | (useful_rows < 3))


def is_useful(row: dict[str, Column]) -> Column:
    return (_text(row["product_name"]) != "") & ((_text(row["product_url"]) != "") | (_text(row["sku"]) != "") | (_text(row["price"]) != ""))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


# Names of rows that sum up a search.
SUMMARY_NAMES = [r"(?i)^\d[\d,]*\s+results?\s+for\b", r"(?i)^\d[\d,]*\s+items?\s+for\b", r"(?i)^\d[\d,]*\s+products?\s+for\b", r"(?i)^showing\s+\d[\d,]*\s*(?:-|to|\u2013)\s*\d[\d,]*\s+of\s+\d[\d,]*"]


def is_summary_row(row: dict[str, Column]) -> Column:
    """Whether a row sums up a search or category: by its name without item number and code, or a counting name with a URL of no product."""
    from .url import is_product_url

    name, link = F.lower(F.trim(_text(row["product_name"]))), F.lower(F.trim(_text(row["product_url"])))
    coded = (F.trim(_text(row["sku"])) != "") | (F.trim(_text(row["upc"])) != "")
    summary = name.rlike("|".join(f"(?:{p})" for p in SUMMARY_NAMES))
    counting = (F.contains(name, F.lit(" results for ")) & ~coded) | ((link != "") & ~is_product_url(link) & name.rlike(r"\b(results?|items?|products?)\b"))
    return F.when(name == "", False).when(summary, ~coded).otherwise(counting)
