"""Product rows from JSON payloads, markdown and model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, url
from ..functions.money import first_price
from .dedup import first_of_each, single_key

# The spellings of each field in objects, folded, first to last; and which keys mark a product.
SPELLINGS = {
    "product_name": ["product_name", "productName", "name", "title", "description"],
    "brand": ["brand", "brandName", "manufacturer", "vendor"],
    "sku": ["sku", "itemNumber", "itemNo", "itemId", "productId", "id"],
    "upc": ["upc", "gtin", "gtin12", "gtin13", "gtin14", "ean", "barcode"],
    "price": ["price", "salePrice", "unitPrice", "currentPrice"],
    "pack_size": ["packSize", "pack_size", "size"],
    "case_pack": ["casePack", "case_pack", "caseQty", "unitsPerCase"],
    "image_url": ["image_url", "imageUrl", "image", "thumbnail", "thumbnailUrl", "src"],
    "product_url": ["product_url", "productUrl", "url", "href", "canonicalUrl", "pdpUrl", "detailUrl"],
}
PRODUCT_KEYS = {"name", "title", "productname", "description", "sku", "itemnumber", "productid", "id", "price", "brand", "image", "imageurl", "url", "href", "producturl", "upc", "ean", "gtin", "barcode"}
#: Products of a payload that one walk of the customary implementation gives; here a parameter, and all by default.
LIMIT = 3000
_FIELDS = list(SPELLINGS)
_ROWS = "page_id long, ord int, " + ", ".join(f"{f} string" for f in _FIELDS)


def _fold(key: str) -> str:
    return re.sub("[-_]", "", str(key)).lower()


def seen(value) -> Iterator[dict | str]:
    """Objects with at least two product keys, outer ones first, and the text values of all objects, in the order of a walk.

    The walk keeps its own stack, so that depth is bounded by memory alone.
    """
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            if len({_fold(k) for k in x} & PRODUCT_KEYS) >= 2:
                yield x
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += [y for y in reversed(x) if not isinstance(y, str)]


def look_up(obj: dict, names: list[str]) -> str:
    """The first value under any of the names, however spelled."""
    folded = {_fold(k): v for k, v in obj.items()}
    for n in names:
        v = folded.get(_fold(n))
        v = v[0] if isinstance(v, list) and v else v
        v = (v.get("name") or v.get("url") or v.get("value")) if isinstance(v, dict) else v
        if v not in (None, "") and not isinstance(v, (dict, list)):
            return str(v).strip()
    return ""


def _emit(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[pa.RecordBatch]:
    names, kinds = ["page_id", "ord", *_FIELDS], [pa.int64(), pa.int32(), *[pa.string()] * len(_FIELDS)]
    for b in batches:
        rows = [(page, k, *(r.get(f, "") for f in _FIELDS)) for page, base, body in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body")), strict=True) for k, r in enumerate(rows_of(base or "", body or ""))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href) if href else ""
    except ValueError:  # no URL, such as an open bracket in a host
        return ""


def product_of(obj: dict, base: str) -> dict | None:
    """The fields of an object that has a name and one of product URL, item number, code, price and image; else None."""
    r = {f: look_up(obj, names) for f, names in SPELLINGS.items()}
    r |= {c: _absolute(base, r[c]) for c in ("image_url", "product_url")}
    r["product_url"] = r["product_url"] if url.looks_like_product(r["product_url"]) else ""
    r["price"] = f"${r['price']}" if re.fullmatch(r"\d+(\.\d{1,2})?", r["price"]) else r["price"]
    return r if r["product_name"] and any(r[c] for c in ("product_url", "sku", "upc", "price", "image_url")) else None


def _walk(base: str, body: str, most: int | None) -> Iterator[dict | str]:
    """Products and absolute product URLs of a payload, until it gave `most` products (null: all)."""
    try:
        value = json.loads(body)
    except (ValueError, RecursionError):  # deeper than the decoder goes is no payload
        return
    n = 0
    for x in seen(value):
        if isinstance(x, str):
            link = _absolute(base, x)
            if url.looks_like_product(link):
                yield link
        elif r := product_of(x, base):
            yield r
            n += 1
            if n == most:
                return


def walk_payloads(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """Product rows (page_id, url, body: JSON text) of everything in a payload that is a product; `most` products a payload (null: all)."""
    rows_of = lambda base, body: [x for x in _walk(base, body, most) if isinstance(x, dict)]
    return ids.normalize_products(payloads.select("page_id", "url", "body").mapInArrow(lambda b: _emit(b, rows_of), _ROWS))


def payload_links(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """Link rows (page_id, ord, product_url) of the product URLs in a payload, of its products and of any text value, each once a page."""

    def rows_of(base: str, body: str) -> list[dict]:
        found = (x if isinstance(x, str) else x["product_url"] for x in _walk(base, body, most))
        return [{"product_url": x} for x in dict.fromkeys(found) if x]

    rows = payloads.select("page_id", "url", "body").mapInArrow(lambda b: _emit(b, rows_of), _ROWS).select("page_id", "ord", "product_url")
    return first_of_each(rows.withColumn("at", F.struct("page_id", "ord")), F.concat_ws(" ", "page_id", "product_url"), "at").drop("at")


_CARD = r"(?m)^\s*\d+\.\s+\[!\[([^\]]*)\]\(([^)]+)\)\]\(([^)]+)\)"


def markdown_cards(payloads: DataFrame) -> DataFrame:
    """Product rows of numbered image links (page_id, url, body: markdown), one for each product URL of the page's host.

    A card's name is the heading that links to the same URL, else the image's text, else the URL's words.
    """
    cut = F.split(F.regexp_replace("body", _CARD, "\u0001$1\u0002$2\u0002$3\u0002"), "\u0001")
    cards = payloads.select("page_id", "url", F.posexplode(F.slice(cut, F.lit(2), F.greatest(F.size(cut), F.lit(0)))).alias("ord", "card"))
    cards = url.once(cards, p=F.split("card", "\u0002"))
    cards = cards.select("page_id", "url", "ord", F.trim(F.get("p", 0)).alias("alt"), F.trim(F.get("p", 1)).alias("image"), F.trim(F.get("p", 2)).alias("href"), F.coalesce(F.get("p", 3), F.lit("")).alias("rest"))
    cards = cards.select("page_id", "url", "ord", "alt", "rest", url.absolute_url("image", "url").alias("image_url"), url.absolute_url("href", "url").alias("product_url"))
    cards = url.once(cards, key=url.url_key(F.col("product_url")))
    allowed = url.same_host(F.col("product_url"), F.col("url")) & (F.lower("key") != F.lower(url.url_key(F.col("url")))) & ~url.holds_any(F.lower("key"), url.OTHER_PAGES)
    heads = payloads.select("page_id", "url", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^(#{1,6}\s+\[[^\]]+\]\([^)]+\))"), F.lit(1))).alias("h"))
    heads = heads.select("page_id", url.url_key(url.absolute_url(F.regexp_extract("h", r"\(([^)]+)\)$", 1), F.col("url"))).alias("key"), text.clean_markdown(F.regexp_extract("h", r"\[([^\]]+)\]", 1)).alias("heading")).groupBy("page_id", "key").agg(F.max("heading").alias("heading"))
    named = cards.where(allowed).join(heads, ["page_id", "key"], "left")
    name = F.coalesce(F.nullif("heading", F.lit("")), F.nullif(text.clean_markdown(F.col("alt")), F.lit("")), url.name_from_url(F.col("product_url")))
    rows = named.select("page_id", "ord", name.alias("product_name"), text.card_sku(F.col("rest")).alias("sku"), first_price(F.col("rest")).alias("price"), "image_url", "product_url", F.concat_ws(" ", "page_id", "key").alias("_k"))
    rows = rows.where((F.col("product_name") != "") & ~F.col("product_name").rlike(r"(?i)^\d[\d,]*\s+(?:results?|items?|products?)\s+for\b"))
    return first_of_each(rows.withColumn("at", F.struct("page_id", "ord")), F.col("_k"), "at").drop("_k", "at")


def link_rows(payloads: DataFrame) -> DataFrame:
    """Rows of links (page_id, url, links: array of text) that look like product pages; the name comes from the URL."""
    each = payloads.select("page_id", "url", F.posexplode("links").alias("ord", "href")).where(~F.lower("href").rlike(r"^(mailto:|tel:|javascript:|#)"))
    each = each.select("page_id", "url", "ord", url.absolute_url("href", "url").alias("product_url"))
    each = url.once(each, key=url.url_key(F.col("product_url"))).where(url.is_listed_product_url(F.col("product_url"), F.col("url"), F.col("key")))
    rows = each.select("page_id", "ord", url.name_from_url(F.col("product_url")).alias("product_name"), "product_url", F.concat_ws(" ", "page_id", "key").alias("_k"))
    return first_of_each(rows.withColumn("at", F.struct("page_id", "ord")), F.col("_k"), "at").drop("_k", "at")


# The spellings that models use.
MODEL_SPELLINGS = {
    "product_name": ["product_name", "name", "title"], "brand": ["brand", "manufacturer"], "sku": ["sku", "item_number", "itemNumber", "part_number", "model"], "upc": ["upc"], "price": ["price"],
    "pack_size": ["pack_size", "packSize"], "case_pack": ["case_pack", "casePack"], "image_url": ["image_url", "imageUrl", "image"], "product_url": ["product_url", "productUrl", "url"],
}


def rescue_json(answer: str):
    """The JSON value of an answer: without fences, else its widest object or array; None if there is none."""
    body = re.sub(r"\n?```$", "", re.sub(r"^```\w*\n?", "", answer.strip())).strip()
    tries = [body] + [body[a : b + 1] for o, c in ("{}", "[]") if (a := body.find(o)) >= 0 and (b := body.rfind(c)) > a]
    for t in tries:
        try:
            return json.loads(t)
        except (ValueError, RecursionError):
            continue
    return None


def model_rows(answers: DataFrame) -> DataFrame:
    """Product rows of model answers (page_id, url, body): each once by URL, item number or name and price; summaries go."""

    def rows_of(base: str, body: str) -> list[dict]:
        value = rescue_json(body)
        if isinstance(value, dict):
            value = next((value[k] for k in ("products", "items", "results", "data") if isinstance(value.get(k), list)), [])
        found = []
        for x in value if isinstance(value, list) else []:
            if isinstance(x, dict):
                r = {f: " ".join(str(next((x[k] for k in names if x.get(k)), "")).split()) for f, names in MODEL_SPELLINGS.items()}
                r["upc"] = r["upc"] or str(x.get("ean") or x.get("gtin") or "")
                found.append(r | {c: urljoin(base, r[c]) if r[c] else "" for c in ("image_url", "product_url")})
        return found

    rows = answers.select("page_id", "url", "body").mapInArrow(lambda b: _emit(b, rows_of), _ROWS)
    rows = rows.where((F.col("product_name") != "") & ~F.col("product_name").rlike(r"(?i)^\d[\d,]*\s+(?:results?|items?|products?)\s+for\b"))
    rows = first_of_each(rows.withColumn("at", F.struct("page_id", "ord")), F.concat_ws(" ", "page_id", single_key()), "at").drop("at")
    return ids.normalize_products(rows)
