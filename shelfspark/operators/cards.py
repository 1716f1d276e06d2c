"""Product cards of listing pages: which elements are cards, and each field by a list of sources, best first.

A page is walked as a tree in a Python worker: most sources look at a node's neighbours only, and a page is small.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plain import MONEY, clean_title, is_catalog_sku, is_category_name, squeeze
from ..sources.dom import Page, host, kept, leads, per_page, resolve
from ..sources.nodes import CHROME_TAGS, FRAME_LEVELS, FRAME_MARKS
from .detail import FRAME_TEXTS, MAYBE_PATHS, OTHER_PATHS, PRODUCT_PATHS
from .pages import CARD_MARKS

# Marks of cards, of links that lead to no product, of names, brands and codes.
MARKS = ["product", "item", "card", "listing", "tile", "result"]
OTHER_LINKS = [
    "/collections/", "/category/", "/categories/", "/search", "/cart", "/checkout", "/account", "/login", "/register", "/wishlist", "/compare",
    "/pages/", "/blogs/", "/tag/", "/tags/", "/contact", "/about", "/faq", "/help", "/plus/",
]
NAME_MARKS = ["name", "title", "description", "itemdescription", "product-title", "product-details"]
NAME_ATTRS = ["data-name", "data-product-name", "data-title", "data-description", "data-product-title", "aria-label"]
BRAND_MARKS = ["brand", "vendor", "manufacturer", "make"]
IMAGE_ATTRS = ["src", "data-src", "data-lazy-src", "data-original", "data-img", "data-image", "data-full-src"]
SKU_ATTRS = ["data-sku", "data-product-id", "data-id", "data-item-id", "data-pid"]
SKU_TEXTS = [r"item\s*number\s*#\s*([A-Z0-9\-]{2,})", r"item\s*#\s*([A-Z0-9\-]{2,})", r"sku\s*#?\s*([A-Z0-9\-]{2,})", r"model\s*#?\s*([A-Z0-9\-]{2,})"]
SKU_MARKS = ["sku", "product-sku", "mpn", "part-number", "model", "item-number"]
UNIT_AFTER_SLASH = r"/\s*(?:case|each|ea|cs|box|bx|pack|pk|set|dozen|dz|lb|oz|gal|qt|pt|ct)"
UNIT_AFTER_PRICE = r"\$\s*\d[\d,]*(?:\.\d{2})?\s+(BX|CT|CS|EA|PK|DZ|CA|LB|OZ|GL|QT|PT|BD|RL|SH|TB|BG|BT|JR|DR)\b"
PRICE_PREFIXES = [r"^last\s+purchased\s*", r"^plus\s+member\s+price\s*", r"^member\s+price\s*"]
NAMED_PRICE = r"(?:sale\s+price|your\s+price|now|final|member\s+price)\s*\$\s*(\d[\d,]*(?:\.\d{2})?)"
#: Points of a price by the classes of its element, then by its text.
PRICE_CLASS_POINTS = [(5, ["price", "cost", "pricing", "amount"]), (2, ["sale", "current", "final", "now"]), (-3, ["original", "was", "old", "compare", "regular"])]
PRICE_TEXT_POINTS = [(1, ["/ each", "/ case", "/ea", "/cs", "/pack", "/box"]), (2, ["plus member price", "member price"]), (-2, ["regularly", "was $"])]
SILENT = ["script", "style", "form", "select", "option"]
INTENT_STOPS = [
    "https", "http", "www", "html", "page", "products", "product", "store", "wholesale", "search", "category", "categories", "restaurant", "equipment",
    "your", "with", "within", "make", "sure", "sort", "filters", "reach", "webstaurantstore", "stands", "tables",
]
LEAST_CARDS = 2


_FRAME = re.compile("|".join(map(re.escape, FRAME_MARKS)))


@kept
def _frames(page: Page, k: int) -> bool:
    return page.tag(k) in CHROME_TAGS or bool(_FRAME.search(f"{page.classes(k)} {page.attr(k, 'id').lower()}"))


def in_frame(page: Page, i: int) -> bool:
    """Whether one of the next FRAME_LEVELS ancestors is part of the site's frame, by its tag, classes or id."""
    for level, k in enumerate(page.up(i)):
        if level == FRAME_LEVELS or page.tag(k) in ("body", "html"):
            return False
        if _frames(page, k):
            return True
    return False


# --- fields --------------------------------------------------------------------------------------------------------
def _links(page: Page, card: int) -> Iterator[tuple[int, str]]:
    return ((a, h) for a in page.all("a", inside=card) if (h := page.attr(a, "href")))


def name_sources(page: Page, card: int) -> Iterator[str]:
    """Texts that may name a card, best first; some may be empty."""
    for k in [k for k in page.having("data-testid", card) if page.attr(k, "data-testid") == "itemDescription"][:1]:
        yield clean_title(page.text(k, ""))
    for tag in ("h1", "h2", "h3", "h4", "h5"):
        for k in page.all(tag, inside=card)[:1]:
            yield clean_title(page.text(k, ""))
    if (k := page.find(card, lambda i: page.tag(i) not in ("script", "style") and page.marked(i, NAME_MARKS))) is not None:
        yield clean_title(page.text(k, ""))
    said = [clean_title(page.text(a, "")) for a, h in _links(page, card) if leads(h) and not any(x in h.lower() for x in OTHER_LINKS)]
    yield max(((len(t), t) for t in said if len(t) >= 8 and not is_category_name(t)), default=(0, ""))[1]
    for attr in NAME_ATTRS:
        holders = [card, *page.having(attr, card)[:3]]
        yield next((clean_title(v) for k in holders if len(v := page.nodes[k]["attrs"].get(attr, "")) >= 5), "")
    alts = (page.attr(k, "alt") for k in page.all("img", inside=card)[:5])
    yield next((clean_title(a) for a in alts if len(a) >= 8 and not a.lower().startswith(("icon", "logo", "arrow", "btn", "button"))), "")
    yield next((clean_title(t) for a, _ in _links(page, card) if len(t := page.text(a, "")) >= 5 and not is_category_name(t)), "")
    texts = sorted((t for k in page.below(card) if page.tag(k) not in ("script", "style", "select", "option") and len(t := page.text(k, "")) >= 8 and "$" not in t[:3]), key=len, reverse=True)
    yield next((clean_title(t) for t in texts[:3] if len(t) <= 200 and not is_category_name(t)), "")
    yield page.attr(card, "title")


@kept
def name_of(page: Page, card: int) -> str:
    return next((t for t in name_sources(page, card) if t), "")


def brand_of(page: Page, card: int) -> str:
    k = page.find(card, lambda i: page.tag(i) not in ("script", "style") and page.marked(i, BRAND_MARKS))
    return page.text(k, "") if k is not None else ""


def price_text(text: str, named: bool = True) -> str:
    """One price of a text with its unit: the one a label names, the first before a regular one, else the lowest."""
    text = squeeze(text)
    for prefix in PRICE_PREFIXES:
        text = re.sub(prefix, "", text, flags=re.I)
    found = MONEY.findall(text)
    if not found:
        return text.replace(" / ", "/").strip()
    price = found[0]
    if len(found) > 1:
        label = re.search(NAMED_PRICE, text, re.I) if named else None
        if label:
            price = f"${label[1]}"
        elif "regularly" not in text.lower():
            worth = lambda p: float(p.replace("$", "").replace(",", ""))
            price = min((p for p in found if worth(p) > 0), key=worth, default=price)
    if unit := re.search(UNIT_AFTER_SLASH, text, re.I):
        price += re.sub(r"\s+", "", unit[0])
    elif named and (unit := re.search(UNIT_AFTER_PRICE, text, re.I)):
        price += f"/{unit[1].upper()}"
    return price.strip()


def price_points(page: Page, card: int, i: int, text: str) -> int:
    """How likely an element's text is the card's price."""
    low, any_of = text.lower(), lambda c, words: any(w in c for w in words)
    points = sum(n for n, words in PRICE_CLASS_POINTS if page.marked(i, words)) + sum(n for n, words in PRICE_TEXT_POINTS if any_of(low, words))
    points += 2 * bool(re.search(r"\$\s*\d", text)) - 2 * (text.count("$") > 3) + (2 if len(text) <= 40 else 1 if len(text) <= 60 else 0)
    points += -3 if any("$" in page.text(k, "") for k in page.kids(i)) else 4  # the innermost element
    deep = page.nodes[i]["depth"] - page.nodes[card]["depth"]
    return points + (2 if 3 <= deep <= 8 else 1 if deep == 2 else 0)


def price_of(page: Page, card: int) -> str:
    """The price of the best element (of equal ones that of the shorter text), with the unit that stands beside it."""
    best = None
    for i in page.below(card):
        text = page.text(i, "")
        if page.tag(i) not in SILENT and "$" in text and len(text) <= 160:
            rank = (price_points(page, card, i, text), -len(text))
            if best is None or rank > best[0]:
                best = rank, i, text
    if best is None:
        return ""
    _, i, text = best
    price = price_text(text)
    if "$" not in price or "/" in price:
        return price if "$" in price else ""
    around = page.kids(page.parent(i))
    beside = [k for k in around if k > i] + [k for k in around if k < i]
    unit = next((page.text(k, "").upper() for k in beside if page.marked(k, ["unit", "uom"])), "")
    return f"{price}/{unit}" if unit and len(unit) <= 5 else price


def strict_price_of(page: Page, card: int) -> str:
    """The first price of an element that a class calls a price, among the first fifty of the card."""
    for i in list(page.below(card))[:50]:
        text = page.text(i, "")
        if page.tag(i) not in SILENT and page.marked(i, ["price", "cost", "pricing"]) and "$" in text and len(text) <= 160 and "$" in (price := price_text(text, named=False)):
            return price
    return ""


def sku_of(page: Page, card: int) -> str:
    """An item number: data attributes, then what a label in the text announces, then an element that a class calls one."""
    for attr in SKU_ATTRS:
        if v := next((v for k in (card, *page.having(attr, card)) if (v := page.attr(k, attr))), ""):
            return v.upper()
    text = page.text(card)
    if m := next((m for p in SKU_TEXTS if (m := re.search(p, text, re.I))), None):
        return m[1].upper()
    k = page.find(card, lambda i: page.tag(i) not in ("script", "style") and page.marked(i, SKU_MARKS))
    m = re.search(r"[A-Z0-9\-]{2,}", page.text(k, ""), re.I) if k is not None else None
    return m[0].upper() if m else ""


def image_of(page: Page, card: int, url: str) -> str:
    """The first image of the card, else of the element around it."""
    around = page.parent(card)
    for inside in (card, *([around] if around >= 0 and page.tag(around) not in ("body", "html") else [])):
        for k in page.all("img", inside=inside)[:5]:
            if v := next((v for a in IMAGE_ATTRS if (v := page.attr(k, a)) and not v.startswith("data:")), ""):
                return resolve(url, v)
    return ""


def link_points(page: Page, a: int, href: str, url: str) -> int | None:
    """How likely a link is the product's: path, text, card around it and image inside; None for a link that leads elsewhere."""
    full = resolve(url, href)
    if not leads(href) or host(full) != host(url):
        return None
    path = re.sub(r"^[a-z][a-z0-9+.\-]*://[^/?#]*|[?#].*$", "", full.lower())
    slug = path.rstrip("/").rpartition("/")[2]
    points = 4 * any(x in path for x in PRODUCT_PATHS) + 2 * any(x in path for x in MAYBE_PATHS) + (len(slug) > 3 and not slug.isdigit())
    if any(x in path for x in OTHER_PATHS):
        points = -5
    low = page.text(a).lower()
    points += 0 if not low else -3 if any(w in low for w in FRAME_TEXTS) else -1 if len(low) > 60 else 0
    carded = any(page.marked(k, CARD_MARKS) or any(m in page.attr(k, "id").lower() for m in CARD_MARKS) for level, k in enumerate(page.up(a)) if level < 8 and page.tag(k) not in ("body", "html"))
    return points + 2 * carded + 2 * bool(page.all("img", inside=a))


def url_of(page: Page, card: int, url: str) -> str:
    """The best link of at least one point, else the first that names a product, else the first."""
    found = list(_links(page, card))
    best = max(((p, -k, h) for k, (a, h) in enumerate(found) if (p := link_points(page, a, h, url)) is not None and p >= 1), default=None)
    if best:
        return resolve(url, best[2])
    href = next((h for _, h in found if any(w in h.lower() for w in ("product", "item", "detail", "p/"))), found[0][1] if found else "")
    return resolve(url, href)


# --- which elements are cards --------------------------------------------------------------------------------------
def intent_terms(page: Page, url: str) -> set[str]:
    """Words of four characters or more of the URL, the title and the first headings that tell what a page is about."""
    said = [url, *(page.text(k) for k in page.all("title")[:1]), *(page.text(k) for k in page.all("h1", "h2")[:4])]
    return {w for s in said for w in re.findall(r"[a-z0-9]{4,}", s.lower().replace("-", " ")) if w not in INTENT_STOPS and not w.isdigit()}


def overlap(text: str, terms: set[str]) -> int:
    return len(terms & set(re.findall(r"[a-z0-9]{4,}", text.lower().replace("-", " "))))


@kept
def meaning_of(page: Page, i: int) -> str:
    """The texts and targets of an element that tell what it is about."""
    told = [page.text(k, "") for k in page.having("data-testid", i) if page.attr(k, "data-testid") == "itemDescription"][:6]
    return " ".join(filter(None, told + [x for a, h in list(_links(page, i))[:12] for x in (page.text(a, ""), h)]))


class Shape:
    """What an element holds."""

    PRODUCT = ["product", "item", "detail", "/p/", "/g/", "/products/", "/product/"]
    UTILITY = ["/plus/", "/search", "/category", "/categories/", "/collections/", "/cart", "/account", "/login", "/compare", "/wishlist"]

    def __init__(self, page: Page, i: int):
        self.text = page.text(i)
        hrefs = [h.lower() for _, h in _links(page, i)]
        utility = [any(x in h for x in self.UTILITY) for h in hrefs]
        slug = lambda h: h.rstrip("/").rpartition("/")[2]
        self.strong = sum(leads(h) and not u and (any(x in h for x in self.PRODUCT) or len(slug(h)) > 5 and not slug(h).isdigit()) for h, u in zip(hrefs, utility, strict=True))
        self.links, self.utility, self.images, self.children = len(hrefs), sum(utility), len(page.all("img", inside=i)), page.nodes[i]["n_children"]
        self.priced = bool(re.search(r"\$\s*\d", self.text))
        self.coded = bool(re.search(r"(?i)\b(?:sku|item\s*(?:no|number|#)|part\s*(?:no|number|#))\b", self.text))
        classes = page.classes(i)
        self.wrapper = "container" in classes and "product-box-container" not in classes and "product-container" not in classes

    def points(self) -> int:
        n = 5 if self.strong == 1 else 2 if self.strong else 0
        n += 3 if self.images == 1 else 1 if self.images else 0
        n += 2 * self.priced + self.coded - self.wrapper
        n += 2 if 40 <= len(self.text) <= 700 else -4 if len(self.text) > 2200 else 0
        n += 2 if self.children <= 8 else -4 if self.children >= 18 else 0
        n -= 3 if self.utility >= 3 else 1 if self.utility else 0
        return n - 3 * (self.links >= 12)

    def plausible(self) -> bool:
        return (
            20 <= len(self.text) <= 3000 and 0 < self.strong and self.links <= 18 and self.children <= 28
            and not (self.utility >= 4 and self.strong <= 1) and bool(self.images or self.priced or self.coded)
        )


shape_of = kept(Shape)


def _weight(shared: int, each: int, most: int) -> int:
    return -10 if shared == 0 else -4 if shared == 1 else min(each * shared, most)


def names_weight(page: Page, group: list[int], terms: set[str]) -> int:
    """How well the names of a group's first elements fit the page."""
    if not terms:
        return 0
    names = [t for i in group[:8] if (t := name_of(page, i))]
    return _weight(overlap(" ".join(names), terms), 4, 12) if names else -8


def innermost(page: Page, found: list[int]) -> list[int]:
    """Elements that hold no other of them within fifteen levels, if two are left."""
    holders = {k for i in found for level, k in enumerate(page.up(i)) if level < 15}
    left = [i for i in found if i not in holders]
    return left if len(left) >= LEAST_CARDS else found


def cards_of(page: Page, url: str) -> list[int]:
    """The elements of a page that are product cards: the best group of equal tag and classes.

    Groups are ranked by the shape of their first element and by how their names fit the page; the first group with two
    plausible cards that fits counts, else the one with most plausible cards, else all candidates that hold no other.
    """
    terms = intent_terms(page, url)
    found = [i for i in page.below() if page.marked(i, MARKS) and not in_frame(page, i)]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i in found:
        groups[page.tag(i), frozenset(page.nodes[i]["attrs"].get("class", "").split())].append(i)
    ranked = []
    for group in groups.values():
        if len(group) >= LEAST_CARDS:
            shape, about, fits = shape_of(page, group[0]), meaning_of(page, group[0]), names_weight(page, group, terms)
            shared = overlap(about, terms) if terms else 0
            points = shape.points() + (_weight(shared, 3, 9) if terms else 0)
            ranked.append(((points + fits, fits, shared, shared, shape.strong, shape.images, shape.priced, -shape.utility, -shape.children, len(group)), group))
    if not ranked:
        return innermost(page, found)
    ranked.sort(key=lambda x: x[0], reverse=True)
    second: list[int] = []
    for _, group in ranked:
        good = [i for i in group if (s := shape_of(page, i)).plausible() and (not terms or overlap(meaning_of(page, i), terms) or s.priced and (s.images or s.coded))]
        if len(good) >= LEAST_CARDS:
            if not terms or names_weight(page, good, terms) >= 0:
                return good
            second = good if len(good) > len(second) else second
    return second or innermost(page, found)


_FIELDS = "ord int, product_name string, brand string, sku string, price string, strict_price string, image_url string, product_url string"


def listing_cards(pages: DataFrame) -> DataFrame:
    """Rows of the product cards of listing pages (page_id, url, html), in document order.

    A row has two of name, URL and image, and a name, a price or an item number; it isn't named like a category, and
    a URL counts once a page, for its first card.
    """

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        seen: set[str] = set()
        for i in cards_of(page, url):
            name, link, image = name_of(page, i), url_of(page, i, url), image_of(page, i, url)
            price, sku = price_of(page, i), sku_of(page, i)
            if bool(name) + bool(link) + bool(image) < 2 or not (name or price or sku) or is_category_name(name) or link and link in seen:
                continue
            seen.add(link)
            yield i, name, brand_of(page, i), sku, price, strict_price_of(page, i), image, link

    return per_page(pages, _FIELDS, rows_of)


def page_intent(pages: DataFrame) -> DataFrame:
    """(page_id, terms): what a page is about, in alphabetical order."""
    return per_page(pages, "terms array<string>", lambda page, url: iter([(sorted(intent_terms(page, url)),)]))


# --- rendered cards ------------------------------------------------------------------------------------------------
# Classes, attributes and labels of the fields of a rendered card.
PRICE_FIRST = ["current-price", "sale-price", "unit-price", "price-value", "price-amount", "product-price"]
UNIT_NEXT = r"(?i)(CS|EA|LB|OZ|CT|PK|BX|BG|DZ|GAL|QT|PT|CASE|EACH|POUND)\b"
CARD_NAMES = ["product-name", "productname", "item-name", "itemname", "product-title", "producttitle", "card-title"]
CARD_BRANDS = ["brand", "vendor", "manufacturer"]
CARD_SKU_ATTRS = ["data-sku", "data-product-id", "data-supc", "data-item-number", "data-product-code"]
CARD_SKUS = ["supc", "item-number", "itemnumber", "item-id", "product-id", "sku", "product-code", "catalog-number"]
CARD_SKU_LABELS = ["sku", "item #", "item no", "item number", "item id", "part number", "part #", "product #", "supc", "product code", "catalog #"]
CARD_PACKS = ["pack-size", "packsize", "pack-info", "pack-qty", "unit-size"]
CARD_PACK_LABELS = ["pack size", "pack qty", "pack quantity", "units per pack", "qty per pack", "pack of", "per pack", "pack/size"]
CARD_CASE_LABELS = ["case pack", "case qty", "case quantity", "units per case", "qty per case", "inner pack", "master pack"]


def label_value(page: Page, labels: list[str], inside: int = -1) -> str:
    """What stands beside the first text that holds one of the labels: the next element's text, else what follows a colon."""
    for i in page.below(inside):
        text = page.nodes[i]["own_text"]
        if not text or len(text) > 200 or page.tag(i) in ("script", "style"):
            continue
        low = re.sub("[-_]", " ", text.lower()).rstrip(": ").strip()
        if any(x in low for x in labels):
            k = page.after(i)
            if k is not None and 0 < len(v := page.text(k, "")) < 100:
                return v
            head, colon, tail = page.text(i).partition(":")
            if colon and tail.strip():
                return tail.strip()
    return ""


def clean_price(page: Page, root: int = -1) -> str:
    """The first $ amount of the price element, with the unit that follows within twelve characters; '' if there is none."""

    def first(text: str) -> str:
        m = re.search(r"\$\s*\d[\d,]*(?:\.\d{1,2})?", text)
        unit = re.match(UNIT_NEXT, text[m.end() : m.end() + 12].strip()) if m else None
        return "" if not m else f"{m[0].strip()} {unit[1].upper()}" if unit else m[0].strip()

    holds = lambda mark: page.find(root, lambda i: page.tag(i) not in ("script", "style", "head") and mark in page.classes(i))
    for mark in PRICE_FIRST:
        if (i := holds(mark)) is not None:
            around = page.parent(i)
            if p := first(page.text(around if around not in (root, -1) else i)):
                return p
    for mark in ("price", "cost", "amount"):
        if (i := holds(mark)) is not None and (p := first(page.text(i))):
            return p
    return first(page.text(root))


def rendered_card(page: Page, url: str) -> tuple:
    """The fields of one card's inner HTML."""
    text_of = lambda marks: next((t for m in marks for i in page.below() if page.tag(i) not in ("script", "style", "head") and m in page.classes(i) and (t := page.text(i))), "")
    headed = next((t for tag in ("h1", "h2", "h3", "h4", "h5") for i in page.all(tag)[:1] if (t := page.text(i, ""))), "")
    name = headed or text_of(CARD_NAMES) or next((page.attr(i, "aria-label") for i in page.all("a") if page.attr(i, "aria-label")), "")
    codes = [next((page.attr(i, a) for i in page.below() if page.has(i, a)), "") for a in CARD_SKU_ATTRS]
    codes += [next((page.text(i, "") for i in page.below() if m in page.classes(i)), "") for m in CARD_SKUS]
    sku = next((c for c in (*codes, label_value(page, CARD_SKU_LABELS)) if is_catalog_sku(c)), "").strip()
    image = next((resolve(url, v) for i in page.all("img") for a in IMAGE_ATTRS[:4] if (v := page.attr(i, a)) and not v.startswith("data:")), "")
    link = next((resolve(url, h) for i in page.all("a") if (h := page.attr(i, "href")) and not h.startswith(("#", "javascript"))), "")
    return name, text_of(CARD_BRANDS), clean_price(page), sku, text_of(CARD_PACKS) or label_value(page, CARD_PACK_LABELS), label_value(page, CARD_CASE_LABELS), image, link


def rendered_cards(cards: DataFrame) -> DataFrame:
    """Product rows of cards whose inner HTML was captured one by one (page_id, url, html)."""
    return per_page(cards, "product_name string, brand string, price string, sku string, pack_size string, case_pack string, image_url string, product_url string", lambda page, url: iter([rendered_card(page, url)]))


def suspicious_prices(rows: DataFrame, share: float = 0.8, least: int = 6) -> DataFrame:
    """`rows` (page_id, price, strict_price) with the strict price where one price fills more than `share` of a page's priced rows."""
    priced = rows.where("price <> ''").groupBy("page_id", "price").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    odd = priced.where((F.col("all") >= least) & (F.col("most") > share * F.col("all"))).select("page_id", F.lit(True).alias("odd"))
    return rows.join(odd, "page_id", "left").withColumn("price", F.when(F.col("odd") & (F.col("strict_price") != ""), F.col("strict_price")).otherwise(F.col("price"))).drop("odd")
