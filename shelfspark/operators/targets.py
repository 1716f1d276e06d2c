"""Which links of a listing lead to product pages: containers, scored targets and passes over links."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import holds_any
from ..sources.dom import Page, host, leads, per_page, resolve
from .detail import RICH_FROM
from .layouts import links_of_rows

# Marks of containers and regions, parts of URLs, words of links and of product data.
CONTAINERS = ["product", "item", "card", "tile", "grid-item", "listing-item", "result", "catalogue", "prod-card", "product-card", "product-item"]
CARDS = ["product", "item", "card", "tile", "grid-item", "listing", "result", "catalogue"]
REGION_TAGS = ["nav", "header", "footer", "aside"]
REGION_IDS = [
    "nav", "navigation", "main-nav", "site-nav", "top-nav", "header", "site-header", "page-header", "footer", "site-footer", "sidebar", "side-bar",
    "breadcrumb", "breadcrumbs", "filters", "facets", "announcement-bar", "cookie-bar",
]
SIGNALS = ["/products/", "/product/", "/item/", "/p/", "/pd/", "/dp/", "/catalog/", "/shop/", "/buy/", "product_detail", "productdetail", "product-detail", "itemdetail", "item-detail", "item_detail"]
REJECTED = [
    "/collections/", "/collection/", "/categories/", "/category/", "/pages/", "/blogs/", "/blog/", "/search", "/tag/", "/tags/", "/cart", "/checkout", "/account", "/login",
    "/register", "/wishlist", "/compare", "/review", "/contact", "/about", "/faq", "/help", "/policy", "/terms", "/privacy", "/sitemap", "/feed", "/rss", "/api/",
    "javascript:", "mailto:", "tel:", "#",
]
TARGET_REJECTED = [
    "/collections/", "/category/", "/categories/", "/search", "/cart", "/checkout", "/account", "/login", "/register", "/wishlist", "/compare", "/pages/", "/blogs/", "/tag/",
    "/tags/", "/contact", "/about", "/faq", "/help", "javascript:", "mailto:", "tel:",
]
TARGET_HIGH = ["/products/", "/product/", "/item/", "/items/", "/detail/", "/pd/", "/catalog/product/", "/shop/product/", "/sku/", "/prod/"]
TARGET_SOME = ["/p/", "/view/", "/buy/"]
TARGET_FRAME = ["view all", "see all", "shop all", "browse", "next", "previous", "prev", "back", "home", "filter", "sort", "contact", "about", "faq", "help", "login", "sign in", "register"]
TARGET_ACTIONS = ["add to cart", "add to bag", "buy now", "checkout", "purchase", "add to order", "buy"]
TARGET_DETAILS = ["details", "detail", "view details", "more details", "view product", "product details", "item details", "view item", "quick view", "info", "information", "order", "view", "see more"]
PRODUCT_WORDS = [
    "order", "details", "detail", "item", "product", "sku", "barcode", "gtin", "upc", "ean", "specifications", "specs", "case", "pack", "unit", "price", "qty", "quantity",
    "part number", "catalog", "model",
]
DATA_LINKS = ["data-href", "data-url", "data-link", "data-product-url", "data-pdp-url", "data-item-url"]
CLICK = r"(?i)(?:location\.href|window\.location(?:\.href)?)\s*=\s*['\"]([^'\"]+)['\"]"
CLICK_PATH = r"['\"](/[^'\"?#]+)['\"]"
LEAST_SCORE, MOST_TRIED, LEAST_MEMBERS, LEVELS = 1, 5, 2, 10


def target_score(url: Column, text: Column, source: Column, wraps_image: Column, around: Column) -> Column:
    """How likely a target leads to a product page, by its URL, text and source and by the words of its container."""
    u, t = F.lower(url), F.lower(F.trim(text))
    slug = F.regexp_replace(F.regexp_extract(F.regexp_replace(u, "/+$", ""), "([^/]*)$", 1), r"\?.*$", "")
    path = F.when(holds_any(u, TARGET_HIGH), 4).when(holds_any(u, TARGET_SOME), 2).otherwise(0) + F.when((F.length(slug) > 4) & ~slug.rlike(r"^\d+$"), 1).otherwise(0)
    words = sum((F.contains(F.lower(around), F.lit(w)).cast("int") for w in PRODUCT_WORDS), F.lit(0))
    return (
        F.when(holds_any(u, TARGET_REJECTED), -5).otherwise(path)
        + F.when(t == "", 1).when(holds_any(t, TARGET_FRAME), -3).when(holds_any(t, TARGET_ACTIONS), -2).when(holds_any(t, TARGET_DETAILS), 3).when(F.length(t) > 100, -1).otherwise(0)
        + F.when(wraps_image, 2).otherwise(0) + F.when(source.isin([a for a in DATA_LINKS if a != "data-link"]), 2).otherwise(0) + F.when(words >= 5, 2).when(words >= 2, 1).otherwise(0)
    )


def regions(page: Page) -> set[int]:
    """The nodes of a site's frame: whole elements by tag or exact id."""
    out: set[int] = set()
    for i, n in enumerate(page.nodes):
        if (n["tag"] in REGION_TAGS or "id" in n["attrs"] and page.attr(i, "id").lower() in REGION_IDS) and i not in out:
            out |= {i, *page.below(i)}
    return out


def containers(page: Page, without: set[int] = frozenset()) -> list[int]:
    """The largest group of marked elements of one tag and classes, the first on ties; none of fewer than two."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i in page.having("class"):
        if i not in without and page.marked(i, CONTAINERS):
            groups[page.tag(i), tuple(sorted(page.nodes[i]["attrs"].get("class", "").split()))].append(i)
    best = max(groups.values(), key=len, default=[])
    return best if len(best) >= LEAST_MEMBERS else []


def targets(page: Page, holder: int, url: str) -> Iterator[tuple[str, str, str, str, bool]]:
    """(url, tag, text, source, wraps_image) of everything in a container that leads somewhere on the page's host, each URL once."""
    seen: set[str] = set()

    def new(href: str) -> str:
        full = resolve(url, href)
        if not full or host(full) != host(url) or full in seen:
            return ""
        seen.add(full)
        return full

    for a in page.all("a", inside=holder):
        if leads(h := page.attr(a, "href")) and (u := new(h)):
            yield u, "a", page.text(a), "href", bool(page.all("img", inside=a))
    for i in page.below(holder):
        if page.has(i, "onclick") and (m := re.search(CLICK, page.attr(i, "onclick")) or re.search(CLICK_PATH, page.attr(i, "onclick"))) and (u := new(m[1])):
            yield u, page.tag(i), page.text(i), "onclick_url", False
    for attr in DATA_LINKS:
        for i in page.below(holder):
            if leads(h := page.attr(i, attr)) and (u := new(h)):
                yield u, page.tag(i), page.text(i), attr, bool(page.all("img", inside=i))


def page_targets(pages: DataFrame) -> DataFrame:
    """(page_id, container, ord, url, tag, text, source, wraps_image, score) of the targets of every container outside the frame."""

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        for i in containers(page, regions(page)):
            around = page.text(i)
            for k, t in enumerate(targets(page, i, url)):
                yield (i, k, *t, around)

    found = per_page(pages, "container int, ord int, url string, tag string, text string, source string, wraps_image boolean, around string", rows_of)
    return found.withColumn("score", target_score(F.col("url"), F.col("text"), F.col("source"), F.col("wraps_image"), F.col("around"))).drop("around")


def best_targets(scored: DataFrame, by: list[str], most: int = MOST_TRIED) -> DataFrame:
    """The first `most` targets of each group that score enough, numbered by falling score; the earlier of equal ones first."""
    from .merge import top_k

    return top_k(scored.where(F.col("score") >= LEAST_SCORE), by, [F.desc("score"), F.asc("ord")], most)


def first_rich(tried: DataFrame, judged: DataFrame, by: list[str]) -> DataFrame:
    """The target of each group to use: the first in rank order whose page is rich, else that of the highest page score.

    `tried` (by, rank, url), `judged` (url, score: of the page): targets without a stored page are out.
    """
    both = tried.select(*by, "rank", "url").join(judged.select("url", F.col("score").alias("page_score")), "url")
    rich = F.col("page_score") >= RICH_FROM
    # a rich one beats every other; of rich ones the first, of others the best, then the first
    order = F.struct(rich.alias("rich"), F.when(rich, F.lit(0)).otherwise(F.col("page_score")).alias("s"), (-F.col("rank")).alias("first"))
    return both.groupBy(*by).agg(F.max_by(F.struct("url", "page_score"), order).alias("_best")).select(*by, "_best.url", "_best.page_score", (F.col("_best.page_score") >= RICH_FROM).alias("is_rich"))


def _in_card(page: Page, a: int) -> bool:
    if page.all("img", inside=a):
        return True
    for level, k in enumerate(page.up(a)):
        if level == LEVELS or page.tag(k) in ("body", "html"):
            return False
        if page.marked(k, CARDS) or page.all("img", inside=k):
            return True
    return False


def _any_in(words: list[str], text: str) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def open_links(page: Page, url: str) -> list[tuple[int, str, bool]]:
    """(node, URL, whether it has a product part) of the links on the page's host that no part of their URL rejects."""
    out, own = [], host(url)
    for a in page.all("a"):
        full = resolve(url, page.attr(a, "href"))
        if full and host(full) == own and not _any_in(REJECTED, low := full.lower()):
            out.append((a, full, _any_in(SIGNALS, low)))
    return out


def scan_links(page: Page, links: list[tuple[int, str, bool]], without: set[int], carded: bool, signalled: bool) -> list[str]:
    """The URLs of `open_links`, each once; with a product part and inside a card if so asked."""
    out: dict[str, None] = {}
    for a, full, signal in links:
        if a not in without and full not in out and (signal or not signalled) and (not carded or _in_card(page, a)):
            out[full] = None
    return list(out)


def link_passes(page: Page, url: str) -> Iterator[tuple[int, list[tuple[str, list[str]]]]]:
    """The passes over a page's links in turn, each as (pass, [(link, alternatives)]); the least that a pass must find: 1, 2, 1, 1, 0."""
    yield -1, list(links_of_rows(page, url))
    frame = regions(page)
    by_card, seen = [], set()
    for i in containers(page, frame):
        around = page.text(i).lower()
        scored = sorted(((_plain_score(t, around), -k, t[0]) for k, t in enumerate(targets(page, i, url))), reverse=True)
        good = [u for s, _, u in scored if s >= LEAST_SCORE and u not in seen and not any(x in u.lower() for x in REJECTED)]
        if good:
            seen.add(good[0])
            by_card.append((good[0], good[1:]))
    yield 0, by_card if len(by_card) >= LEAST_MEMBERS else []
    links = open_links(page, url)
    for n, (without, carded, signalled) in enumerate([(frame, True, True), (set(), False, True), (frame, True, False)], 1):
        yield n, [(u, []) for u in scan_links(page, links, without, carded, signalled)]


def _plain_score(target: tuple, around: str) -> int:
    """`target_score` of one target."""
    url, _, text, source, wraps = target
    u, t = url.lower(), text.lower().strip()
    has = lambda s, words: any(w in s for w in words)
    slug = u.rstrip("/").rpartition("/")[2].partition("?")[0]
    n = -5 if has(u, TARGET_REJECTED) else (4 if has(u, TARGET_HIGH) else 2 if has(u, TARGET_SOME) else 0) + (len(slug) > 4 and not slug.isdigit())
    n += 1 if not t else -3 if has(t, TARGET_FRAME) else -2 if has(t, TARGET_ACTIONS) else 3 if has(t, TARGET_DETAILS) else -1 if len(t) > 100 else 0
    words = sum(w in around for w in PRODUCT_WORDS)
    return n + 2 * wraps + 2 * (source in DATA_LINKS and source != "data-link") + (2 if words >= 5 else 1 if words >= 2 else 0)


def product_links(pages: DataFrame) -> DataFrame:
    """(page_id, pass, ord, product_url, alternatives): the links of the first pass over a page that finds any."""

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        for n, found in link_passes(page, url):
            if found:
                for k, (u, others) in enumerate(found):
                    yield n, k, u, others
                return

    return per_page(pages, "pass int, ord int, product_url string, alternatives array<string>", rows_of)
