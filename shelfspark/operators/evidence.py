"""What of a page is shown to a matcher or a model: chunks of evidence, cleaned markup, compact texts, a profile."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import labelled_upc
from ..sources.dom import Page, per_page, resolve
from ..sources.nodes import VOID
from .cards import MARKS
from .detail_page import identifier_evidence
from .payloads import payload_links, walk_payloads

# Words that make a text evidence, by where it stands.
META_WORDS, ATTR_WORDS = ["upc", "gtin", "barcode", "product"], ["upc", "gtin", "barcode"]
SCRIPT_WORDS, SPEC_WORDS = ["upc", "gtin", "barcode", "__initial_state__", "__next_data__"], ["upc", "gtin", "barcode", "item id", "model number"]
SPEC_TAGS = ["table", "dl", "ul", "div", "section"]
CODE_WORDS = "upc|gtin|ean|barcode|sku|productid|product_id|mfr|manufacturer"
BLOCKS = ["access denied", "403 forbidden", "captcha", "are you a robot", "cloudflare", "ddos-guard", "please enable javascript", "checking your browser", "you have been blocked"]
PRODUCT_HREFS = ["product", "item", "detail", "p/", "/pd/", "/dp/"]
DROPPED = {"script", "style", "noscript", "svg", "iframe", "video", "audio", "canvas", "map", "object", "embed", "nav", "header", "footer", "aside", "menu"}
NOISY = {"style", "class", "id", "data-gtm", "data-analytics", "data-track", "data-testid", "data-cy", "data-test", "aria-label", "aria-describedby", "onclick", "onload", "onerror"}
LISTING_MARKS = ["product", "item", "card", "sku", "price"]
#: A compact text is for a model: its size, the elements of each kind and the characters of an element are limits of the format.
MOST_CHARS, MOST_ELEMENTS, ELEMENT_CHARS, ELEMENT_LINKS = 180_000, 160, 1800, 4
JOINT = "\n\n---\n\n"


def _attrs(page: Page, i: int) -> str:
    return " ".join(f"{k}={v}" for k, v in page.nodes[i]["attrs"].items())


def _holds(s: str, words: list[str]) -> bool:
    low = s.lower()
    return any(w in low for w in words)


def evidence_chunks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, location, text): texts of a page that may hold an identifier, from the most telling place to the whole text."""

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        found = [("meta", f"{_attrs(page, k)} {page.attr(k, 'content')}") for k in page.all("meta") if page.attr(k, "content") and _holds(_attrs(page, k), META_WORDS)]
        found += [("data_attr", s) for k in page.below() if (s := _attrs(page, k)) and _holds(s, ATTR_WORDS)]
        scripts = [(k, s) for k in page.all("script") if (s := page.source(k).strip())]
        found += [("json_ld", s) for k, s in scripts if page.attr(k, "type") == "application/ld+json"]
        found += [("script", s) for _, s in scripts if _holds(s, SCRIPT_WORDS)]
        found += [("dom_specs", s) for k in page.all(*SPEC_TAGS) if _holds(s := page.text(k), SPEC_WORDS)]
        if whole := page.text():
            found.append(("body_text", whole))
        for k, (where, said) in enumerate(found):
            yield k, where, said

    return per_page(pages, "ord int, location string, text string", rows_of)


def evidence_upc(chunks: DataFrame) -> DataFrame:
    """(page_id, upc, evidence_location): the UPC of the first chunk that has one."""
    found = chunks.select("page_id", "ord", "location", labelled_upc(F.col("text")).alias("upc")).where("upc <> ''")
    return found.groupBy("page_id").agg(F.min_by(F.struct("upc", "location"), "ord").alias("b")).select("page_id", "b.upc", F.col("b.location").alias("evidence_location"))


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside: list[str] = []  # open elements that are left out

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.inside.append(tag)
        elif not self.inside:
            kept = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if k not in NOISY)
            self.out.append(f"<{tag}{kept}{'/' if tag in VOID else ''}>")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag in self.inside:
                while self.inside.pop() != tag:
                    pass
        elif tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(escape(data, quote=False))


def clean_html(html: str) -> str:
    """Markup without scripts, frame, media, comments and noisy attributes, white space folded."""
    c = _Cleaner()
    c.feed(html or "")
    c.close()
    return re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n", "".join(c.out))).strip()


def _joined(chunks: Iterator[str], most: int) -> str:
    """Chunks until they hold more than `most` characters."""
    out, size = [], 0
    for c in chunks:
        out.append(c)
        size += len(c) + 2
        if size - 2 > most:
            break
    return JOINT.join(out)


def listing_evidence(page: Page, url: str) -> str:
    """The title, then the texts and links of marked elements, tables and the main part."""

    def of(kind) -> Iterator[str]:
        for k in [i for i in page.below() if kind(i)][:MOST_ELEMENTS]:
            if len(said := page.text(k)) >= 20:
                links = [f"{page.text(a)} -> {resolve(url, page.attr(a, 'href'))}".strip() for a in page.all("a", inside=k) if page.attr(a, "href")][:ELEMENT_LINKS]
                yield said[:ELEMENT_CHARS] + ("\nLinks: " + " | ".join(links) if links else "")

    def chunks() -> Iterator[str]:
        yield from (f"PAGE TITLE: {page.text(k)}" for k in page.all("title")[:1])
        for mark in LISTING_MARKS:
            yield from of(lambda i, m=mark: m in page.nodes[i]["attrs"].get("class", ""))
        yield from of(lambda i: page.tag(i) == "table")
        yield from of(lambda i: page.tag(i) == "main")

    found = list(chunks())
    if len(found) < 4:
        found.append(page.text(gap="\n")[:MOST_CHARS])
    return _joined(iter(found), MOST_CHARS)


def detail_evidence(page: Page, url: str, product: dict[str, str], code: str, source: str) -> str:
    """The task, what is known of the product, headings, meta tags, and the scripts and elements around codes."""

    def chunks() -> Iterator[str]:
        yield "TASK: Extract only the product matching the known listing SKU/name below. Ignore related, recommended, sponsored, and recently viewed products."
        yield f"DETAIL URL: {url}"
        for title, field in (("PRODUCT", "product_name"), ("SKU", "sku"), ("PRICE", "price")):
            yield f"KNOWN {'LISTING ' if field == 'product_name' else ''}{title}: {product.get(field) or ''}"
        if code:
            yield f"BARCODE EVIDENCE ({source or 'page'}): {code}"
        yield from filter(None, (page.text(k) for k in page.all("title", "h1", "h2")))
        for k in page.all("meta"):
            name = page.attr(k, "name") or page.attr(k, "property") or page.attr(k, "itemprop")
            if page.attr(k, "content") and re.search("(?i)title|description|sku|upc|gtin|ean|barcode|image|price", name):
                yield f"META {name}: {page.attr(k, 'content')}"
        for k in page.all("script"):
            for m in re.finditer(rf"(?is).{{0,700}}(?:{CODE_WORDS}).{{0,1200}}", page.source(k)):
                yield "SCRIPT: " + " ".join(m[0].split())
        for i, own in page.said():
            if re.search("(?i)UPC|GTIN|EAN|Barcode|SKU|Manufacturer|Item #", own):
                holder = next((k for k in (i, *page.up(i)) if page.tag(k) in ("li", "tr", "div", "section", "span")), None)
                yield (page.text(holder) if holder is not None else own)[:2000]

    return _joined(chunks(), MOST_CHARS)[:200_000]


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(page_id, cleaned): the markup that a model is shown."""
    return per_page(pages.withColumn("raw", F.col("html")).withColumn("html", F.lit("")), "cleaned string", lambda page, url, raw: iter([(clean_html(raw or ""),)]), ("raw",))


def compact_listings(pages: DataFrame) -> DataFrame:
    return per_page(pages, "evidence string", lambda page, url: iter([(listing_evidence(page, url),)]))


def compact_details(pages: DataFrame, products: DataFrame) -> DataFrame:
    """(page_id, evidence) of detail pages, with what their listing rows (product_url, product_name, sku, price) say."""
    known = products.groupBy(F.col("product_url").alias("url")).agg(F.first(F.struct("product_name", "sku", "price")).alias("p"))
    codes = identifier_evidence(pages).select("page_id", "identifier", F.col("source").alias("code_source"))
    both = pages.join(known, "url", "left").join(codes, "page_id", "left")
    both = both.select("page_id", "url", "html", *(F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("product_name", "sku", "price")), F.coalesce("identifier", F.lit("")).alias("code"), F.coalesce("code_source", F.lit("")).alias("source"))
    run = lambda page, url, name, sku, price, code, source: iter([(detail_evidence(page, url, {"product_name": name, "sku": sku, "price": price}, code, source),)])
    return per_page(both, "evidence string", run, ("product_name", "sku", "price", "code", "source"))


def page_profiles(pages: DataFrame) -> DataFrame:
    """What explains a page without products: blocked, script-built, its title, marked elements and their most common kinds, product links."""

    def rows_of(page: Page, url: str, raw: str | None) -> Iterator[tuple]:
        raw = raw or ""
        low = raw.lower()
        body = "".join(page.text(k, "") for k in page.all("body")[:1])
        scripted = len(body) < 500 or "window.__" in raw or "react" in low or "vue" in low or "__NEXT_DATA__" in raw or "ng-app" in raw
        marked = [i for i in page.below() if page.marked(i, MARKS)]
        kinds = Counter((page.tag(i), tuple(sorted(set(page.nodes[i]["attrs"].get("class", "").split())))) for i in marked)
        top = [f"{tag}.{'.'.join(classes)}:{n}" for (tag, classes), n in kinds.most_common(5)]
        links = [h for a in page.all("a") if (h := page.attr(a, "href")) and _holds(h, PRODUCT_HREFS)]
        yield any(b in low for b in BLOCKS), scripted, next((page.text(k) for k in page.all("title")[:1]), "(no title)"), len(marked), top, len(links), links[:5]

    schema = "possible_bot_block boolean, js_rendered_likely boolean, page_title string, candidate_count int, top_patterns array<string>, product_links_found int, product_link_samples array<string>"
    return per_page(pages.withColumn("raw", F.col("html")), schema, rows_of, ("raw",))


def script_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, body) of the JSON scripts of pages."""
    marks = ("__next_data__", "__nuxt_data__")

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        for k in page.all("script"):
            if "json" in page.attr(k, "type").lower() or page.attr(k, "id").lower() in marks:
                source = page.source(k).strip()
                if source[:1] in ("{", "["):
                    yield url, source

    return per_page(pages, "url string, body string", rows_of)


def script_products(pages: DataFrame) -> DataFrame:
    """Product rows of everything in a page's JSON scripts that is a product."""
    return walk_payloads(script_payloads(pages))


def script_links(pages: DataFrame) -> DataFrame:
    return payload_links(script_payloads(pages))
