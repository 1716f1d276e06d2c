"""The twenty fields of a product's own page: each by a list of sources, best first.

Structured data comes first, then meta tags, then marked elements, then labels in the text, then scripts. What needs the
page's tree runs in a Python worker, one page at a time; how the texts are cleaned and combined are column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, money, pack, text
from ..functions.plain import code_digits, is_detail_sku
from ..schema import first_present
from ..sources.dom import Page, per_page, resolve
from .cards import label_value
from .detail import LABELS

# Meta tags, marks, attributes, labels and script keys of the fields.
NAME_METAS = [("property", "og:title"), ("name", "twitter:title")]
BRAND_METAS = [("itemprop", "brand"), ("property", "product:brand"), ("name", "brand")]
SKU_METAS = [("itemprop", "sku"), ("itemprop", "productID"), ("name", "sku")]
PRICE_METAS = [("itemprop", "price"), ("property", "product:price:amount")]
IMAGE_METAS = [("property", "og:image"), ("name", "twitter:image")]
ID_METAS = [
    *[("itemprop", n) for n in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "productID")],
    *[("name", n) for n in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "ean", "upc", "barcode")],
    *[("property", n) for n in ("product:gtin", "product:upc", "product:ean")],
]
BRAND_MARKS, PRICE_MARKS, RAW_PRICE_MARKS = ["brand", "vendor", "manufacturer"], ["price", "cost", "amount"], ["price", "cost", "amount", "rate"]
SKU_ATTRS = ["data-sku", "data-product-id", "data-variant-id", "data-item-id"]
MINIMUM_ATTRS = ["data-min-qty", "data-minimum-quantity", "data-min-order", "data-moq", "min"]
PACK_LABELS = ["pack size", "pack qty", "pack quantity", "units per pack", "qty per pack", "pack of", "per pack"]
CASE_CODE_LABELS = ["gtin case", "gtin (case)", "case gtin", "gtin case code"]
SALES_LABELS = ["sales per case", "units per case", "case qty", "case quantity"]
ID_KEYS = ["upc", "ean", "barcode", "productID", "productId", "gtin", "gtin8", "gtin12", "gtin13", "gtin14", "UPC", "EAN", "GTIN", "Barcode"]
PRICE_KEYS = ["price", "salePrice", "sale_price", "unitPrice"]
CASE_KEYS = ["casePack", "case_pack", "caseQty", "case_qty", "unitsPerCase", "units_per_case"]
UPC_LABELS = ["item upc", "product upc", "upc code", "upc/ean", "upc/ean code", "universal product code", "upc", "ean", "barcode", "gtin"]
UPC_TEXT = (
    r"(?i)(?:item\s+upc|product\s+upc|upc\s*code|upc\s*/\s*ean|universal\s+product\s+code|product\s*id|barcode|gtin\s*14|gtin\s*13|gtin\s*12|gtin\s*8|gtin|ean|upc)"
    r"[:\s\-]{0,30}(\d[\d\s]{6,15}\d)"
)
TIER = r"(?i)\b1\s*(?:ea|each|unit|pc|pcs)?\b\s*[@=]\s*\$?\s*([\d,]+\.\d{2})(?:\s*(ea|each|unit|pc|pcs|lb|oz|kg|g))?"
PRICE_AND_UNIT = r"(?i)\$\s*([\d,]+\.\d{2})(?:\s*(?:per\s+)?(ea|each|unit|pc|pcs|lb|oz|kg|g|cs|case))?"
SITE_PRICE_UNIT, SITE_PRICE = r"(?i)(\$\d[\d,]*\.\d{2})\s*/\s*(Each|EA|Case|CS)", r"(\$\d[\d,]*\.\d{2})"
LD_IDS = ["gtin14", "gtin13", "gtin12", "gtin8", "gtin", "productID"]
MOST_PRICE_TEXTS = 5


def some(*found: str) -> str:
    return next((s for s in found if s), "")


def product_object(page: Page) -> dict:
    """The first JSON-LD object of the page whose type is Product, in a list or a graph too."""
    for k in page.all("script"):
        if page.attr(k, "type") != "application/ld+json":
            continue
        try:
            value = json.loads(page.source(k) or "")
        except (ValueError, RecursionError):
            continue
        top = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        inner = [y for x in top if isinstance(x.get("@graph"), list) for y in x["@graph"] if isinstance(y, dict)]
        if found := next((x for x in (*top, *inner) if x.get("@type") == "Product"), None):
            return found
    return {}


def _str(x) -> str:
    return "" if x is None or isinstance(x, (dict, list)) else str(x).strip()


class Detail:
    """One page's sources."""

    def __init__(self, page: Page, url: str):
        self.page, self.url, self.ld = page, url, product_object(page)
        offers = self.ld.get("offers")
        offers = next((x for x in offers if isinstance(x, dict)), {}) if isinstance(offers, list) else offers
        self.offer = offers if isinstance(offers, dict) else {}
        self.metas: dict[tuple[str, str], str] = {}
        for k in page.all("meta"):
            for kind in ("itemprop", "name", "property"):
                if page.has(k, kind):
                    self.metas.setdefault((kind, page.attr(k, kind)), page.attr(k, "content"))
        self.scripts = [s for k in page.all("script") if (s := page.source(k))]

    def meta(self, wanted: list[tuple[str, str]]) -> str:
        return some(*(self.metas.get(w, "") for w in wanted))

    def marked(self, words: list[str]) -> list[int]:
        return [i for i in self.page.below() if self.page.tag(i) not in ("script", "style") and self.page.marked(i, words)]

    def label(self, labels: list[str]) -> str:
        return label_value(self.page, labels)

    def script(self, keys: list[str]) -> str:
        """The value of one of the keys in a script: as a quoted text after a bare key, in a flat object, in a whole JSON value."""
        folded = {k.lower() for k in keys}
        for source in self.scripts:
            bare = (m[2].strip() for m in re.finditer(r'(\w+)\s*:\s*"([^"]*?)"', source) if re.sub(r"^(?:BM|bm|vm|VM)", "", m[1]).lower() in folded)
            if v := next((v for v in bare if v), ""):
                return v
            whole = [source.strip()] if source.strip()[:1] in ("{", "[") else []
            for piece in (*(m[0] for m in re.finditer(r"\{[^{}]{10,}\}", source)), *whole):
                try:
                    value = json.loads(piece)
                except (ValueError, RecursionError):
                    continue
                for obj in value if isinstance(value, list) else [value]:
                    if isinstance(obj, dict) and (v := some(*(str(obj.get(k) or "").strip() for k in keys))):
                        return v
        return ""

    def brand(self) -> str:
        own = self.ld.get("brand")
        marks = self.marked(BRAND_MARKS)[:1]
        return some(_str(own.get("name") if isinstance(own, dict) else own), self.meta(BRAND_METAS), *(self.page.text(k, "") for k in marks)) or self.label(LABELS["brand"])

    def sku(self) -> str:
        held = (next((self.page.attr(i, a) for i in self.page.below() if self.page.has(i, a)), "") for a in SKU_ATTRS)
        first = some(_str(self.ld.get("sku")), self.meta(SKU_METAS)) or self.label(LABELS["sku"]) or some(*held)
        if is_detail_sku(first):
            return first
        if is_detail_sku(labelled := self.label(["sku"])):
            return labelled
        m = re.search(r"(?i)\bSKU\s*(\d{3,})\b", self.page.text())
        return m[1] if m and is_detail_sku(m[1]) else ""

    def identifier(self) -> tuple[str, str, str]:
        """(digits, as written, where from)."""
        tiers = [
            ("json_ld", (_str(self.ld.get(k)) for k in LD_IDS)), ("meta", (self.metas.get(w, "") for w in ID_METAS)), ("label", iter([self.visible_code()])), ("script", iter([self.script(ID_KEYS)])),
        ]
        return next(((d, raw, tier) for tier, found in tiers for raw in found if (d := code_digits(raw))), ("", "", ""))

    def visible_code(self) -> str:
        """A code that a label in the text announces: right after it, after a colon, in the next element, in the element
        after the one around it, or in the next text."""
        page = self.page
        if (m := re.search(UPC_TEXT, page.text())) and (d := code_digits(m[1])):
            return d
        for i, own in page.said():
            if len(own) > 200 or not any(w in re.sub(r"[:.\s]+", " ", own.lower()) for w in UPC_LABELS):
                continue
            after = [s.partition(":")[2].strip() for s in (own, page.text(i)) if ":" in s]
            near = [x for s in after if s for x in (s.split()[0], s)]
            around = page.parent(i)
            near += [page.text(k, "") for k in (page.after(i), page.after(around) if around >= 0 else None) if k is not None]
            near += page.pieces[page.nodes[i]["said"][0] + 1 :][:1]
            if d := next((d for s in near if (d := code_digits(s))), ""):
                return d
        return ""

    def price(self) -> tuple[str, str, str]:
        """(price, unit price, pricing unit) as written."""
        said = self.page.text()
        if m := re.search(SITE_PRICE_UNIT, said):
            return m[1], m[1], m[2].upper()
        if m := re.search(SITE_PRICE, said):
            return m[1], *self.unit_price(said)
        price = _str(self.offer.get("price"))
        if not price and (raw := self.meta(PRICE_METAS)):
            price = f"${raw.replace(',', '')}" if re.fullmatch(r"\d[\d,]*(?:\.\d{2})?", raw) else _str(self.offer.get("priceCurrency")) + raw
        if not price and (marks := self.marked(PRICE_MARKS)[:1]) and (m := re.search(r"\$\d[\d,]*\.\d{2}", self.page.text(marks[0]))):
            price = m[0]
        return price or self.script(PRICE_KEYS), *self.unit_price(said)

    def unit_price(self, said: str) -> tuple[str, str]:
        if m := re.search(TIER, said):
            return f"${m[1].replace(',', '')}", (m[2] or "EA").upper()
        raw = self.label(LABELS["unit_price"])
        m = re.search(PRICE_AND_UNIT, raw)
        return (f"${m[1].replace(',', '')}", (m[2] or "").upper()) if m else (raw.strip(), "")

    def case_pack(self) -> str:
        sales = re.search(r"\d+", self.label(SALES_LABELS)) or re.search(r"(?i)sales\s+per\s+case\s*(\d+)", self.page.text())
        return self.label(LABELS["case_pack"]) or (sales[sales.re.groups] if sales else "") or self.script(CASE_KEYS)

    def minimum(self) -> str:
        held = (next((self.page.attr(i, a) for i in self.page.below() if self.page.has(i, a)), "") for a in MINIMUM_ATTRS)
        return self.label(LABELS["minimum_order_qty"]).strip() or next((v for v in held if v.isdigit()), "")

    def bulk_price(self) -> str:
        raw = self.label(LABELS["bulk_price"])
        m = re.search(PRICE_AND_UNIT, raw)
        return f"${m[1].replace(',', '')}" if m else raw.strip()

    def image(self) -> str:
        own = self.ld.get("image")
        own = next((x for x in own if x), "") if isinstance(own, list) else own
        own = own.get("url") if isinstance(own, dict) else own
        held = (v for k in self.page.all("img") for a in ("src", "data-src", "data-lazy-src") if (v := self.page.attr(k, a)) and not v.startswith("data:"))
        return some(_str(own), self.meta(IMAGE_METAS)) or resolve(self.url, next(held, ""))

    def row(self) -> tuple:
        page = self.page
        name = some(_str(self.ld.get("name")), self.meta(NAME_METAS), *(page.text(k, "") for k in page.all("h1")[:1]))
        digits, raw, source = self.identifier()
        case_code = re.sub(r"\D", "", self.label(CASE_CODE_LABELS))
        prices = [t for k in self.marked(RAW_PRICE_MARKS)[:MOST_PRICE_TEXTS] if (t := page.text(k)) and len(t) < 200]
        return (
            name, self.brand(), self.sku(), digits, raw, source, *self.price(), self.label(LABELS["unit_size"]), self.label(PACK_LABELS), self.case_pack(), self.bulk_price(), self.minimum(),
            " | ".join(prices), self.image(), case_code if 8 <= len(case_code) <= 18 else "",
        )


_RAW = "name brand sku digits raw_code evidence raw_price raw_unit_price raw_unit unit_size pack_size raw_case bulk_price minimum_order_qty raw_price_text image_url gtin_case".split()


def raw_details(pages: DataFrame) -> DataFrame:
    """The sources' texts of each page (page_id, url, html)."""
    return per_page(pages, ", ".join(f"{c} string" for c in _RAW), lambda page, url: iter([Detail(page, url).row()]))


def detail_fields(pages: DataFrame) -> DataFrame:
    """One row of twenty fields for each page, and where its identifier comes from."""
    raw = raw_details(pages).join(pages.select("page_id", "url"), "page_id")
    name = text.detail_name(F.col("name"))
    in_title = pack.parse_title_abbreviation(name)
    unit_price = first_present(money.plain_dollars(F.col("raw_unit_price")), "raw_unit_price")
    price = first_present(money.plain_dollars(F.col("raw_price")), F.trim("raw_price"))
    # a price of something else on the page is no price; only a price with its unit tells
    with_unit = F.col("raw_unit").isin("EACH", "EA", "CASE", "CS") & (F.col("raw_price") == F.col("raw_unit_price"))
    told, told_unit = F.when(with_unit, unit_price).otherwise(""), F.when(with_unit, F.col("raw_unit")).otherwise("")
    code = ids.identifier_fields(F.col("digits"))
    empty = F.col("digits") == ""
    kind = lambda c: F.when(empty, "").otherwise(code[c]).alias(c)
    return raw.select(
        "page_id", name.alias("product_name"), "brand", "sku", F.col("digits").alias("upc"), F.when(money.is_page_wide_price(price, told, told_unit), told).otherwise(price).alias("price"),
        unit_price.alias("unit_price"), F.col("raw_unit").alias("pricing_unit"), first_present("unit_size", in_title["unit_size"]).alias("unit_size"), "pack_size",
        first_present("raw_case", in_title["case_pack"]).alias("case_pack"), "bulk_price", "minimum_order_qty", "raw_price_text", "image_url", F.coalesce("url", F.lit("")).alias("product_url"), "gtin_case",
        kind("ean"), kind("gtin"), F.when(empty, "").otherwise(F.when(F.col("evidence").isin("json_ld", "meta"), F.col("raw_code")).when(F.col("evidence") == "script", F.col("raw_code")).otherwise(F.col("digits"))).alias("barcode_raw"), kind("identifier_type"),
        F.col("evidence").alias("identifier_source"),
    )


# --- identifiers with a valid check digit --------------------------------------------------------------------------
# Keys of structured data that hold an identifier, and elements that may hold a label and its value.
EVIDENCE_KEYS = ["gtin14", "gtin13", "gtin12", "gtin8", "gtin", "upc", "ean", "barcode"]
HOLDERS = {"li", "tr", "td", "div", "section", "span", "p"}
_DIGITS = re.compile(r"\b\d[\d\s-]{6,20}\d\b")


def valid_code(s: str) -> str:
    """The first run of digits, spaces and hyphens that is a GTIN with its check digit."""
    for found in _DIGITS.findall(s or ""):
        d = [int(c) for c in found if c.isdigit()]
        if len(d) in (8, 12, 13, 14) and len(set(d)) > 2 and (sum(x * (3 if k % 2 == 0 else 1) for k, x in enumerate(d[-2::-1])) + d[-1]) % 10 == 0:
            return "".join(map(str, d))
    return ""


def identifier_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, identifier, identifier_type, source): the first valid GTIN of JSON-LD, meta tags, visible labels, scripts."""

    def sources(page: Page) -> Iterator[tuple[str, str, str]]:
        for k in page.all("script"):
            if "ld+json" in page.attr(k, "type").lower():
                for key in EVIDENCE_KEYS:
                    if m := re.search(rf'"{key}"\s*:\s*"([^"]+)"', page.source(k), re.I):
                        yield m[1], key, f"jsonld:{key}"
        for k in page.all("meta"):
            name = some(page.attr(k, "name"), page.attr(k, "property"), page.attr(k, "itemprop"))
            if re.search("(?i)gtin|upc|ean|barcode", name):
                yield page.attr(k, "content"), name.lower(), f"meta:{name}"
        for i, own in page.said():
            if re.search("(?i)UPC|GTIN|EAN|Barcode", own):
                holder = next((k for k in (i, *page.up(i)) if page.tag(k) in HOLDERS and len(page.text(k)) <= 500), None)
                if holder is not None:
                    yield page.text(holder), "visible_label", "visible_label"
        for k in page.all("script"):
            for m in re.finditer(r"""(?i)(gtin(?:8|12|13|14)?|upc|ean|barcode)[\w-]*["']?\s*[:=]\s*["']([^"']+)["']""", page.source(k)):
                yield m[2], m[1].lower(), "script_identifier_field"

    def rows_of(page: Page, url: str) -> Iterator[tuple]:
        found = next(((d, kind, where) for s, kind, where in sources(page) if (d := valid_code(s))), None)
        if found:
            yield found

    return per_page(pages, "identifier string, identifier_type string, source string", rows_of)

