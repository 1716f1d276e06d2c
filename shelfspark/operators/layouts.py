"""Catalogs as labelled rows: HTML tables, grids of equal elements under a row of labels, and order-form tables."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.ids import normalize_products
from ..functions.plain import MONEY, code_digits, squeeze
from ..functions.url import looks_like_product
from ..sources.dom import Page, host, leads, per_page, resolve
from .pages import HEADERS

LEAST_COLUMNS, LEAST_ROWS, LEAST_SHARE = 2, 2, 0.25
#: A grid's labels must name one of these.
IDENTITY = {"image", "product_name", "sku"}
# Where an image's source may stand, and the columns whose links lead to a product, best first.
IMAGE_ATTRS = ["src", "data-src", "data-lazy-src", "data-original", "data-img", "data-image", "data-full-src"]
LINK_COLUMNS = ["order_target", "sku", "product_name"]
_PRICED = re.compile(r"\$[\d,]+\.\d{2}")


def _word(w: str) -> str:
    return rf"\b{re.escape(w)}" + (r"\b" if w[-1].isalnum() else r"(?=\w)")


_MEANINGS = [(meaning, set(words), re.compile("|".join(map(_word, words)))) for meaning, words in HEADERS.items()]


def meaning_of(label: str) -> str | None:
    """The meaning of a column's label."""
    text = squeeze(re.sub(r"[:\-_/\\|]+", " ", label.lower()))
    return next((meaning for meaning, words, inside in _MEANINGS if text in words or inside.search(text)), None)


@dataclass
class Layout:
    kind: str
    columns: list[tuple[int, str]]  # place and meaning of those that have one
    rows: list[int]
    confidence: float


def cells_of(page: Page, row: int) -> list[int]:
    return page.all("td", "th", inside=row) or page.kids(row)


def _is_head(page: Page, cells: list[int]) -> bool:
    if any(page.tag(c) == "th" for c in cells):
        return True
    known = sum(meaning_of(page.text(c, "")) is not None for c in cells)
    return known >= LEAST_COLUMNS and not any(page.all("img", inside=c) or _PRICED.search(page.text(c, "")) for c in cells)


def _layout(page: Page, kind: str, labels: list[int], rows: list[int]) -> Layout | None:
    columns = [(k, m) for k, c in enumerate(labels) if (m := meaning_of(page.text(c)))]
    share = len(columns) / max(1, len(labels))
    return Layout(kind, columns, rows, share) if len(columns) >= LEAST_COLUMNS and len(rows) >= LEAST_ROWS else None


def tables(page: Page) -> Iterator[Layout]:
    """Tables whose head has two known labels, a quarter of all, over two rows."""
    for t in page.all("table"):
        head, body = page.all("thead", inside=t)[:1], page.all("tbody", inside=t)[:1]
        if head and body:
            heads, rows = page.all("tr", inside=head[0]), page.all("tr", inside=body[0])
        else:
            every = [k for k in page.kids(t) if page.tag(k) == "tr"] or page.all("tr", inside=t)
            every = [r for r in every if page.all("td", "th", inside=r)]
            heads = [r for r in every if _is_head(page, page.all("td", "th", inside=r))][:1]
            rows = [r for r in every if r not in heads]
        if heads and (found := _layout(page, "table", page.all("td", "th", inside=heads[-1]), rows)) and found.confidence >= LEAST_SHARE:
            yield found


def grids(page: Page) -> Iterator[Layout]:
    """Elements of labels without images, and their later siblings of the same tag with about as many children."""
    for i in page.all("div", "li", "ul", "section", "article"):
        labels = page.kids(i)
        if len(labels) < LEAST_COLUMNS or page.all("img", inside=i):
            continue
        meanings = {m for c in labels if (m := meaning_of(page.text(c)))}
        if not meanings & IDENTITY:
            continue
        rows, k = [], i
        while (k := page.after(k)) is not None:
            if page.tag(k) == page.tag(i) and abs(len(page.kids(k)) - len(labels)) <= 1:
                rows.append(k)
        if len(rows) >= LEAST_ROWS and (page.all("img", inside=rows[0]) or len(page.text(rows[0], "")) > 5 or re.search(r"\$[\d,]+", page.text(rows[0]))) and (found := _layout(page, "div_grid", labels, rows)):
            yield found


def layout_of(page: Page) -> Layout | None:
    """The table of the highest confidence, the first on ties; without one the grid."""
    for kind in (tables, grids):
        if found := max(kind(page), key=lambda x: x.confidence, default=None):
            return found
    return None


# --- cells ---------------------------------------------------------------------------------------------------------
def hrefs(page: Page, i: int, url: str, pictures: bool = True) -> list[str]:
    """The links inside an element that stay on the page's host, each once; without those that hold an image if so asked."""
    found = (resolve(url, h) for a in page.all("a", inside=i) if (h := page.attr(a, "href")) and leads(h) and (pictures or not page.all("img", inside=a)))
    return list(dict.fromkeys(u for u in found if host(u) == host(url)))


def _source(page: Page, img: int) -> str:
    return next((v for a in IMAGE_ATTRS if (v := page.attr(img, a)) and not v.startswith("data:")), "")


def best_image(page: Page, cell: int, url: str) -> str:
    """The image of the largest declared area, the first on ties, else a background."""
    number = lambda k, a: int(v) if (v := page.attr(k, a) or "0").isdigit() else 0
    found = [(number(k, "width") * number(k, "height"), -n, s) for n, k in enumerate(page.all("img", inside=cell)) if (s := _source(page, k))]
    if found:
        return resolve(url, max(found)[2])
    styles = (re.search(r"(?i)background(?:-image)?\s*:\s*url\(['\"]?([^'\")\s]+)['\"]?\)", page.attr(k, "style")) for k in page.below(cell))
    return next((resolve(url, m[1]) for m in styles if m), "")


def lowest_price(text: str) -> str:
    found = [p.replace(" ", "") for p in MONEY.findall(text)]
    return min(found, key=lambda p: float(p.strip("$").replace(",", "")), default="")


class Row:
    """One row of a layout."""

    def __init__(self, page: Page, layout: Layout, row: int, url: str):
        self.page, self.row, self.url = page, row, url
        cells = cells_of(page, row)
        self.by: dict[str, list[int]] = defaultdict(list)
        for k, meaning in layout.columns:
            if k < len(cells):
                self.by[meaning].append(cells[k])
        self.first = {layout.columns[j][1]: None for j in range(len(layout.columns) - 1, -1, -1)}
        for k, meaning in reversed(layout.columns):
            self.first[meaning] = cells[k] if k < len(cells) else None

    def text(self, meaning: str) -> str:
        cell = self.first.get(meaning)
        return self.page.text(cell) if cell is not None else ""

    def target(self) -> str:
        """The link of the best column that has one, else the first that isn't an image, else the first."""
        for meaning in LINK_COLUMNS:
            for cell in self.by[meaning]:
                if found := hrefs(self.page, cell, self.url):
                    return found[0]
        return next(iter(hrefs(self.page, self.row, self.url, pictures=False) or hrefs(self.page, self.row, self.url)), "")

    def product(self) -> dict[str, str]:
        page, price = self.page, self.text("price")
        low = lowest_price(price)
        codes = (re.search(r"\b(\d{5,10})\b", page.text(c)) for c in self.by["order_target"])
        image = best_image(page, self.first["image"], self.url) if self.first.get("image") is not None else ""
        image = image or next((resolve(self.url, s) for k in page.all("img", inside=self.row) if (s := _source(page, k))), "")
        return {
            "product_name": self.text("product_name"), "sku": self.text("sku") or next((m[1] for m in codes if m), ""), "price": low or price, "raw_price_text": price if low and len(low) < len(price) else "",
            "case_pack": self.text("case_pack"), "brand": self.text("brand"), "upc": code_digits(self.text("upc")), "pack_size": "" if self.text("case_pack") else self.text("qty"),
            "image_url": image, "product_url": self.target(),
        }


_FIELDS = ["product_name", "sku", "price", "raw_price_text", "case_pack", "brand", "upc", "pack_size", "image_url", "product_url"]


def layout_rows(pages: DataFrame) -> DataFrame:
    """Product rows (page_id, ord, layout, confidence, fields) of each page's table or grid; a row without name, item number and URL goes."""

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        if layout := layout_of(page):
            for row in layout.rows:
                p = Row(page, layout, row, url).product()
                if p["product_name"] or p["sku"] or p["product_url"]:
                    yield (row, layout.kind, layout.confidence, *(p[f] for f in _FIELDS))

    return per_page(pages, "ord int, layout string, confidence double, " + ", ".join(f"{f} string" for f in _FIELDS), rows_of)


def links_of_rows(page: Page, url: str) -> Iterator[tuple[str, list[str]]]:
    """(link, other links) of the rows of a page's layout; a link counts for its first row."""
    layout, seen = layout_of(page), set()
    for row in layout.rows if layout else ():
        main = Row(page, layout, row, url).target()
        if main and main not in seen:
            seen.add(main)
            yield main, [u for u in hrefs(page, row, url) if u != main]


def row_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, product_url, alternatives) of the rows of each page's layout."""
    return per_page(pages, "ord int, product_url string, alternatives array<string>", lambda page, url: ((k, *x) for k, x in enumerate(links_of_rows(page, url))))


# --- order-form tables ---------------------------------------------------------------------------------------------
# Marks of such tables, and of the elements that hold a price.
ORDER_TABLES, ORDER_HEADS = ["product-table", "products", "catalog"], ["description", "price", "qty", "order", "image"]
NO_CODES = {"order", "view", "product"}


def order_tables(pages: DataFrame) -> DataFrame:
    """Product rows of order-form tables: the code ends the first cell, the third holds the name and a category's link,
    the next two a tier such as `EA / 144 EA+`."""

    def price_of(page: Page, row: int) -> str:
        inner = list(page.below(row))
        tests = [lambda i: "ext-price" in page.classes(i).split(), lambda i: page.nodes[i]["attrs"].get("id", "").startswith("ext-price"), lambda i: "price" in page.classes(i).split(), lambda i: page.has(i, "data-price1"), lambda i: page.has(i, "data-price2")]
        for ok in tests:
            k = next((i for i in inner if ok(i)), None)
            if k is not None and (v := squeeze(page.text(k) or page.attr(k, "data-price2") or page.attr(k, "data-price1"))):
                return v
        m = re.search(r"\$\s*\d+(?:\.\d{2})?", page.text(row))
        return m[0].replace(" ", "") if m else ""

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        for t in page.all("table"):
            classes = page.classes(t)
            if not (set(classes.split()) & set(ORDER_TABLES) or "product" in classes):
                continue
            trs = page.all("tr", inside=t)
            if not trs or not any(w in page.text(trs[0]).lower() for w in ORDER_HEADS):
                continue
            for row in trs:
                cells = [k for k in page.kids(row) if page.tag(k) in ("td", "th")]
                if len(cells) < 3 or page.all("th", inside=row):
                    continue
                link = next((u for a in page.all("a", inside=row) if (h := page.attr(a, "href")) and looks_like_product(u := resolve(url, h))), "")
                codes = [c for c in re.findall(r"(?i)\b([A-Z0-9][A-Z0-9._/-]{3,})\b", page.text(cells[0])) if c.lower() not in NO_CODES]
                img = next(iter(page.all("img", inside=row)), None)
                above = next(iter(page.all("a", inside=cells[2])), None)
                a, b = page.nodes[cells[2]]["said"]
                x, y = page.nodes[above]["said"] if above is not None else (b, b)
                name = " ".join(page.pieces[a:x] + page.pieces[y:b]) or (page.attr(img, "alt") if img is not None else "")
                tier = re.search(r"\b([A-Z]{1,4})\s*/\s*([\d.]+)\s*([A-Z]{1,4})\+", " ".join(page.text(c) for c in cells[3:5]))
                sku, price = codes[-1] if codes else "", price_of(page, row)
                if name and (sku or link or price):
                    case = f"{tier[2].rstrip('0').rstrip('.') if '.' in tier[2] else tier[2]} {tier[3]}" if tier else ""
                    yield row, name, sku, price, tier[1] if tier else "", case, resolve(url, page.attr(img, "src")) if img is not None else "", link, page.text(above) if above is not None else ""

    return normalize_products(per_page(pages, "ord int, product_name string, sku string, price string, pack_size string, case_pack string, image_url string, product_url string, category string", rows_of))
