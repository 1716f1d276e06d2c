"""URLs as text: parts, keys, predicates and page numbers."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, parse_qsl, urlencode, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns worked out once a row: as a generator's output they are not copied into every filter and column that reads them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), _PARTS, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(F.coalesce(u, F.lit("")), _PARTS, 2)


def path(u: Column) -> Column:
    return F.regexp_extract(F.coalesce(u, F.lit("")), _PARTS, 3)


def url_key(u: Column) -> Column:
    """Without trailing slashes of the path and without fragment."""
    u = F.regexp_replace(F.coalesce(u, F.lit("")), "#.*$", "")
    return F.regexp_replace(u, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?]*)?[^?]*?)/+(\?.*)?$", "$1$2")


def same_host(u: Column, base: Column) -> Column:
    here, there = F.lower(netloc(u)), F.lower(netloc(base))
    return scheme(u).isin("http", "https") & (here != "") & ((there == "") | (here == there))


def same_site(base: Column, candidate: Column) -> Column:
    """The same host or one below it; a leading www. doesn't count."""
    a, b = (F.regexp_replace(F.lower(netloc(x)), r"^www\.", "") for x in (base, candidate))
    return (a == b) | F.endswith(b, F.concat(F.lit("."), a))


def name_from_url(u: Column) -> Column:
    """The last part of the path as words; '' for general ones."""
    slug = F.regexp_extract(F.regexp_replace(path(u), "/+$", ""), r"([^/]*)$", 1)
    slug = F.trim(F.regexp_replace(F.regexp_replace(slug, r"(?i)\.(?:html?|aspx?|php)$", ""), "[-_]+", " "))
    # Parts that name no product.
    general = F.lower(slug).isin("product", "products", "item", "items", "detail", "details")
    return F.when((slug == "") | general, "").otherwise(F.initcap(slug))


# File types that are no page, parts of URLs that are no product, parts that show a product page.
MEDIA = r"(?i)\.(?:avif|bmp|css|gif|ico|jpe?g|js|pdf|png|svg|webp)(?:$|[?#])"
OTHER_PAGES = [
    "/about", "/account", "/basket", "/blog", "/cart", "/category", "/categories", "/checkout", "/collection", "/collections", "/contact",
    "/customer", "/faq", "/help", "/login", "/logout", "/my-account", "/policy", "/privacy", "/profile", "/register", "/rewards", "/search",
    "/signin", "/signup", "/terms", "/users", "/wishlist", "?product_list", "filter=", "javascript:",
]
PRODUCT_PAGES = ["/products/", "/product/", "/item/", "/p/", "/pd/", "/dp/", "product_detail", "productdetail", "product-detail", "itemdetail", "item-detail", "item_detail"]
PRODUCT_HINTS = ["/product/", "/products/", "/item/", "/items/", "/detail/", "/details/", "/pd/", "/p/", "/sku/", "/prod/", "/catalog/product/", "/shop/product/", "/gp/product/", "/dp/"]


def holds_any(c: Column, parts: list[str]) -> Column:
    found = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(c, F.lit(p))
    return found


def is_product_url(u: Column) -> Column:
    """Whether a URL looks like that of one product: by its parts, or as a shallow slug that ends in a code."""
    low = F.lower(F.trim(F.coalesce(u, F.lit(""))))
    rest = F.regexp_replace(path(low), "^/+|/+$", "")
    shallow = (rest != "") & ~F.contains(rest, F.lit("/"))
    coded = (F.length(rest) >= 12) & F.contains(rest, F.lit("-")) & rest.rlike(r"[a-z][a-z0-9-]*\d[a-z0-9-]*$")
    return F.when((low == "") | low.rlike(MEDIA) | holds_any(low, OTHER_PAGES), False).when(holds_any(low, PRODUCT_PAGES), True).otherwise(shallow & (F.endswith(low, F.lit(".html")) | coded))


def looks_like_product(u: str) -> bool:
    """`is_product_url` of one text."""
    low = u.strip(" ").lower()
    if not low or re.search(MEDIA, low) or any(p in low for p in OTHER_PAGES):
        return False
    if any(p in low for p in PRODUCT_PAGES):
        return True
    rest = (m[3] or "" if (m := re.search(_PARTS, low)) else "").strip("/")
    coded = len(rest) >= 12 and "-" in rest and bool(re.search(r"[a-z][a-z0-9-]*\d[a-z0-9-]*$", rest))
    return rest != "" and "/" not in rest and (low.endswith(".html") or coded)


def is_listed_product_url(u: Column, base: Column, key: Column | None = None) -> Column:
    """Whether a URL on the same host, other than the page's own, has a product page's part and none of another page; `key` is its `url_key`, if at hand."""
    key = F.lower(key if key is not None else url_key(u))
    return same_host(u, base) & (key != F.lower(url_key(base))) & ~holds_any(key, OTHER_PAGES) & holds_any(key, PRODUCT_HINTS)


@F.pandas_udf(T.StringType())
def absolute_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """A link against its page's URL; RFC 3986 resolution has no column expression."""
    return pd.Series([urljoin(b or "", h) if h else "" for h, b in zip(href, base, strict=True)])


# Parameters that number pages, and that count rows.
PAGE_PARAMS = ["page", "p", "pg", "pageNumber", "page[number]", "currentPage"]
OFFSET_PARAMS = ["offset", "start", "skip"]


def page_variants(url: str, target: int, per_page: int | None = None) -> list[str]:
    """URLs under which page `target` of a listing may be found, each once."""
    u = urlparse(url or "")
    query = parse_qs(u.query, keep_blank_values=True)
    put = lambda k, v: u._replace(query=urlencode({**query, k: [str(v)]}, doseq=True)).geturl()
    found = [put(k, target) for k in ([p for p in PAGE_PARAMS if p in query] or PAGE_PARAMS[:1])]
    found += [put(k, per_page * (target - 1)) for k in OFFSET_PARAMS if k in query and per_page and query[k][0].isdigit()]
    for mark in ("/page/", "/p/"):
        head, sep, tail = u.path.rpartition(mark)
        if sep and tail.rstrip("/").isdigit():
            found.append(u._replace(path=f"{head}{sep}{target}{'/' if tail.endswith('/') else ''}").geturl())
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_urls(url: pd.Series, target: pd.Series, per_page: pd.Series) -> pd.Series:
    return pd.Series([page_variants(u, int(t), None if pd.isna(n) else int(n)) for u, t, n in zip(url, target, per_page, strict=True)])


RANGE_OF_TOTAL = r"(?i)(\d[\d,]*)\s*(?:-|–|to)\s*(\d[\d,]*)\s+of\s+(\d[\d,]*)"
PAGE_OF_TOTAL = r"(?i)page\s+\d+\s+of\s+(\d+)"
PLAIN_TOTAL = r"(?i)(\d[\d,]*)\s+(?:items?|products?|results?)\b"


def pagination(text: Column, highest_button: Column | None = None) -> Column:
    """total_products, per_page and total_pages that a listing's text states; a higher page button counts."""
    number = lambda p, k: F.regexp_replace(F.regexp_extract(text, p, k), ",", "").try_cast("int")
    per_page = number(RANGE_OF_TOTAL, 2) - number(RANGE_OF_TOTAL, 1) + 1
    total = number(RANGE_OF_TOTAL, 3)
    ranged = (per_page > 0) & (total > 0)
    plain = F.when(number(PLAIN_TOTAL, 1) >= 2, number(PLAIN_TOTAL, 1))
    pages = F.coalesce(F.when(ranged, F.ceil(total / per_page).cast("int")), number(PAGE_OF_TOTAL, 1))
    return F.struct(
        F.coalesce(F.when(ranged, total), plain).alias("total_products"),
        F.when(ranged, per_page).alias("per_page"),
        (F.greatest(pages, highest_button) if highest_button is not None else pages).alias("total_pages"),
    )


# Parameters of rendered catalogs, of other listings, and those that count rows a page.
RENDERED_PARAMS = ["page", "p", "pg", "pageNumber", "page_number", "currentPage", "current_page", "pageIndex", "page_index"]
LISTING_PARAMS = ["page", "p", "pg", "pageNumber", "Page", "currentPage"]
ROWS_PARAMS = {"perpage", "per_page", "pagesize", "page_size", "limit", "count"}
MOST_RENDERED = 16
SORTED_SITES = ["cdn.shopify.com", "Shopify.shop", "window.Shopify", "shopify-section", "/cdn/shop/"]


def rendered_variants(url: str, target: int) -> list[str]:
    """URLs under which page `target` of a rendered catalog may be found: page parameters, offsets, a path; the first sixteen."""
    u = urlparse(url or "")
    pairs = parse_qsl(u.query, keep_blank_values=True)
    put = lambda k, v: u._replace(query=urlencode([*((a, b) for a, b in pairs if a != k), (k, str(v))])).geturl()
    found = [put(k, target) for k in RENDERED_PARAMS]
    for k, v in pairs:
        if k.lower() in ROWS_PARAMS and re.fullmatch(r"\s*\+?\d+\s*", v) and int(v) > 0:
            found += [put(k2, (target - 1) * int(v)) for k2 in OFFSET_PARAMS]
    bare = u.path.rstrip("/")
    numbered = re.sub(r"(?i)/page/\d+$", f"/page/{target}", bare)
    found.append(u._replace(path=numbered if re.search(r"(?i)/page/\d+$", bare) else f"{bare}/page/{target}").geturl())
    return [x for x in dict.fromkeys(found) if x != url][:MOST_RENDERED]


def listing_variants(url: str, target: int) -> list[str]:
    """URLs under which page `target` of a listing read by a model may be found."""
    u = urlparse(url or "")
    query = parse_qs(u.query, keep_blank_values=True)
    found = [u._replace(query=urlencode({**query, k: [str(target)]}, doseq=True)).geturl() for k in LISTING_PARAMS]
    paths = (re.sub(rf"(?i)(/{mark}/)\d+(/?)$", rf"\g<1>{target}\g<2>", u.path) for mark in ("page", "p"))
    found += [u._replace(path=x).geturl() for x in paths if x != u.path]
    return list(dict.fromkeys(found))


def numbered_page(url: str, target: int) -> str:
    """The URL with its page parameter, `page` without one, set to `target`."""
    u = urlparse(url or "")
    query = parse_qs(u.query, keep_blank_values=True)
    k = next((k for k in PAGE_PARAMS if k in query), PAGE_PARAMS[0])
    return u._replace(query=urlencode({**query, k: [str(target)]}, doseq=True)).geturl()


def feed_bases(url: str) -> list[str]:
    """Where a site's product feed may be: below the collection of the URL, then at the root."""
    u = urlparse(url or "")
    path = u.path.rstrip("/")
    root = f"{u.scheme}://{u.netloc}/"
    collection = path.split("/products/", 1)[0].rstrip("/") if "/collections/" in path else ""
    return list(dict.fromkeys(urljoin(root, x) for x in ([f"{collection}/products.json"] if collection else []) + ["/products.json"]))


def _listed(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(url: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([f(u, int(t)) for u, t in zip(url, target, strict=True)])

    return run


rendered_page_urls, listing_page_urls = _listed(rendered_variants), _listed(listing_variants)


@F.pandas_udf(T.StringType())
def numbered_page_url(url: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([numbered_page(u, int(t)) for u, t in zip(url, target, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def feed_base_urls(url: pd.Series) -> pd.Series:
    return url.map(feed_bases)


def stable_sort(html: Column, u: Column) -> Column:
    """A collection's URL in title order, where the page is of a system whose own order changes and no order is asked for."""
    query = F.regexp_extract(u, _PARTS, 4)
    unsorted = ~query.rlike(r"(^|&)sort_by=[^&]")
    head, rest = F.regexp_extract(u, r"^([^#]*)", 1), F.regexp_extract(u, r"(#.*)?$", 0)
    ordered = F.concat(F.regexp_replace(head, r"\?$", ""), F.when(query == "", F.lit("?")).otherwise("&"), F.lit("sort_by=title-ascending"), rest)
    return F.when(F.contains(path(u), F.lit("/collections/")) & unsorted & holds_any(F.coalesce(html, F.lit("")), SORTED_SITES), ordered).otherwise(u)


def ranged_pagination(text: Column) -> Column:
    """total_products, per_page and total_pages of `a-b of N` alone."""
    p = pagination(text)
    ranged = p["per_page"].isNotNull()
    return F.struct(*(F.when(ranged, p[c]).alias(c) for c in ("total_products", "per_page", "total_pages")))


def counted_pagination(text: Column, buttons: Column) -> Column:
    """total_products from `a-b of N`, else `N items`; total_pages as the highest of at least two page buttons (an array)."""
    number = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("int")
    total = F.coalesce(number(r"\b\d+\s*-\s*\d+\s+of\s+([\d,]+)\b"), number(r"(?i)\b([\d,]+)\s+(?:items?|products?|results?)\b"))
    return F.struct(total.alias("total_products"), F.when(F.size(buttons) >= 2, F.array_max(buttons)).alias("total_pages"))
