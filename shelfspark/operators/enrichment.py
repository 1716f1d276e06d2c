"""Listing rows made richer: by detail pages, by evidence, by providers and retail results, by feeds and hosted payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, scoring
from ..functions.plain import squeeze
from ..schema import first_present
from ..sources.dom import resolve
from .dedup import first_of_each, single_key
from .merge import MERGED, enrich_detail_wins
from .payloads import link_rows, markdown_cards
from .quality import has_identifier, quality_report

DETAIL_CAP = 2000
# Listing columns that fill what a detail page lacks.
BASE_FIELDS = ["image_url", "product_name", "sku", "price", "case_pack", "brand"]


def _cols(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) if c in df.columns else F.lit("") for c in (*MERGED, "product_url")}


def enrich_first(listing: DataFrame, detail: DataFrame, cap: int | None = DETAIL_CAP) -> DataFrame:
    """`enrich_detail_wins` for the first `cap` rows that have a URL (null: all); the others stay as they are."""
    if cap is None:
        return enrich_detail_wins(listing, detail)
    chosen = listing.where(F.col("product_url") != "").select("ord").orderBy("ord").limit(cap).withColumn("_in", F.lit(True))
    marked = listing.join(chosen, "ord", "left")
    rich = enrich_detail_wins(marked.where("_in").drop("_in"), detail)
    return rich.unionByName(marked.where("_in is null").drop("_in"))


def fill_from_base(details: DataFrame, base: DataFrame) -> DataFrame:
    """Detail rows (chosen_url, primary_url) whose empty fields come from the listing row of the chosen URL, else of the primary one."""
    fields = [c for c in BASE_FIELDS if c in details.columns]
    one = base.where(F.col("product_url") != "").groupBy("product_url").agg(F.max_by(F.struct(*fields), "ord").alias("b"))  # a later row replaces an earlier one
    side = lambda name, key: one.select(F.col("product_url").alias(key), F.col("b").alias(name))
    both = details.join(side("_b1", "chosen_url"), "chosen_url", "left").join(side("_b2", "primary_url"), "primary_url", "left")
    b = F.coalesce("_b1", "_b2")
    return both.select(*(first_present(c, b[c]).alias(c) if c in fields else F.col(c) for c in details.columns))


def assign_identifier(products: DataFrame, evidence: DataFrame) -> DataFrame:
    """Products without any identifier take that of the evidence (product_url, identifier, source); upc_source tells where from."""
    e = evidence.groupBy("product_url").agg(F.first(F.struct("identifier", "source")).alias("_e"))
    both = products.join(e, "product_url", "left")
    take = ~has_identifier(products, "upc", "ean", "gtin") & (F.coalesce(F.col("_e.identifier"), F.lit("")) != "")
    code = ids.identifier_fields(F.col("_e.identifier"))
    out = {c: F.when(take, code[c]).otherwise(F.col(c)) if c in products.columns else F.when(take, code[c]).otherwise("") for c in ("upc", "ean", "gtin", "barcode_raw", "identifier_type")}
    source = F.when(take, F.col("_e.source")).otherwise(F.col("upc_source") if "upc_source" in products.columns else F.lit(""))
    return both.withColumns(out | {"upc_source": source, "assigned": take}).drop("_e")


def enrich_public(links: DataFrame, listing: DataFrame, detail: DataFrame) -> DataFrame:
    """One row for each link (product_url): the listing's row, with a valid detail row's fields before its own; nothing without a name and URL."""
    one = lambda df: first_of_each(df.where(F.col("product_url") != ""), F.col("product_url"))
    d = one(detail)
    checked = d.withColumn("_ok", scoring.valid_detail(_cols(d))["is_valid"])
    left = links.select("product_url").distinct().join(one(listing), "product_url", "left")
    fields = [c for c in listing.columns if c not in ("product_url", "ord")]
    right = checked.where("_ok").select("product_url", *(F.col(c).alias(f"d_{c}") for c in fields if c in detail.columns))
    both = left.join(right, "product_url", "left")
    merged = both.select("product_url", *(first_present(f"d_{c}", c).alias(c) if c in detail.columns else F.coalesce(c, F.lit("")).alias(c) for c in fields))
    return merged.where((F.col("product_name") != "") | (F.col("product_url") != ""))


def static_catalog(rows: DataFrame, links: DataFrame, detail: DataFrame, dedup) -> DataFrame:
    """Listing rows, deduplicated, each replaced by its enriched row if its URL is among the links, and deduplicated again."""
    base = dedup(rows)
    rich = enrich_public(links.join(base.select("product_url").distinct(), "product_url", "left_semi"), base, detail)
    fields = [c for c in base.columns if c not in ("product_url", "ord")]
    side = rich.select("product_url", *(F.col(c).alias(f"r_{c}") for c in fields), F.lit(True).alias("_rich"))
    both = base.join(side, "product_url", "left")
    return dedup(both.select(*(F.when(F.col("_rich"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns)))


# --- providers and retail results ----------------------------------------------------------------------------------
def best_provider(found: DataFrame, least: str = "medium") -> DataFrame:
    """Each product's answer (ord, provider, position, upc, confidence) of the highest confidence, the first provider on ties."""
    rank = scoring.confidence_rank(F.col("confidence"))
    good = found.where((rank >= scoring.confidence_rank(F.lit(least))) & (F.coalesce("upc", F.lit("")) != ""))
    order = F.struct(rank.alias("rank"), (-F.col("position")).alias("first"))
    return good.groupBy("ord").agg(F.max_by(F.struct("provider", "upc", "confidence"), order).alias("b")).select("ord", "b.provider", "b.upc", "b.confidence")


def rank_results(scored: DataFrame, limit: int = 5, least: int = 45) -> DataFrame:
    """Each product's search results by score less noise, the first `limit` of at least `least`, with their confidence.

    `scored` (ord, position, title, description, url, site, score): the score of `candidate_score` for the result's candidate.
    """
    noisy = scored.withColumn("score", F.col("score") + scoring.result_noise(F.col("title"), F.col("description"), F.col("url")))
    w = Window.partitionBy("ord").orderBy(F.desc("score"), "position")
    ranked = noisy.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.withColumns({"confidence": scoring.confidence(F.col("score")), "color": scoring.confidence_color(F.col("score"))})


def accepted_results(ranked: DataFrame, upcs: DataFrame, least: int = scoring.RETAIL_ACCEPT) -> DataFrame:
    """Results that score enough and whose page (url) has a UPC, with its place as the reason."""
    both = ranked.where(F.col("score") >= least).join(upcs.select("url", "upc", "evidence_location"), "url")
    return both.withColumn("reason", F.concat(F.lit("retail candidate matched strongly and explicit UPC found in "), "evidence_location"))


def resolve_products(accepted: DataFrame) -> DataFrame:
    """Each product's first accepted result in rank order."""
    fields = [c for c in accepted.columns if c != "ord"]
    return accepted.groupBy("ord").agg(F.min_by(F.struct(*fields), "rank").alias("b")).select("ord", "b.*")


OUTCOMES = ["already", "enriched", "missing", "provider_unavailable", "insufficient_data", "skipped_budget"]


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many rows of each run ended in which way: with their own identifier, resolved outside, without a match, ..."""
    status, native = F.coalesce("resolution_status", F.lit("")), F.coalesce("upc_12", F.lit("")) != ""
    kind = (
        F.when(status == "externally_resolved", "enriched").when(native | status.isin("native", "converted"), "already").when(status.isin("provider_unavailable", "provider_partially_unavailable"), "provider_unavailable")
        .when(status == "external_lookup_skipped_budget", "skipped_budget").when(status == "insufficient_data", "insufficient_data").when(status == "no_match_found", "missing")
    )
    return rows.withColumn("_kind", kind).groupBy(*by).agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in OUTCOMES))


# --- reports ------------------------------------------------------------------------------------------------------
def diagnostics(products: DataFrame, crawls: DataFrame, by: list[str]) -> DataFrame:
    """Each run's quality report with what its crawl says (expected_products, expected_pages, pages_visited, stop_reason)."""
    told = ["expected_products", "expected_pages", "pages_visited", "stop_reason"]
    both = products.join(crawls.select(*by, *told), by, "left")
    report = quality_report(both, [*by, *told], F.col("expected_products"), F.col("expected_pages"), F.col("pages_visited"), F.coalesce("stop_reason", F.lit("")))
    return report.withColumn("crawl", F.struct(*told)).drop(*told)


def feed_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """What a feed's export says of itself: products, rows, rows with a barcode, and where barcodes came from."""
    has = F.coalesce("upc", F.lit("")) != ""
    return rows.groupBy(*by).agg(
        F.countDistinct("source_product_id").alias("feed_products"), F.count("*").alias("rows"), F.count_if(has).alias("rows_with_barcode"), F.count_if(F.coalesce("upc_source", F.lit("")).startswith("detail_")).alias("barcodes_from_detail"),
        F.bround(F.count_if(has) / F.count("*"), 3).alias("barcode_share"),
    )


# --- feeds and hosted payloads -------------------------------------------------------------------------------------
def balanced_object(source: str, marker: str) -> str:
    """The JSON object that follows a marker: braces are counted outside of texts; '' if none closes."""
    at = source.find(marker)
    start = source.find("{", at + len(marker)) if at >= 0 else -1
    depth, quoted = 0, False
    for m in re.finditer(r'\\.|["{}]', source[start:], re.S) if start >= 0 else ():
        c = m[0]
        if quoted or c[0] == "\\":
            quoted = quoted and c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += 1 if c == "{" else -1
            if not depth:
                return source[start : start + m.end()]
    return ""


def _code(s) -> str:
    d = re.sub(r"\D", "", squeeze(str(s or "")))
    return d if 8 <= len(d) <= 14 else squeeze(str(s or ""))


def fill_variants(product: dict, page: str) -> dict:
    """A feed product whose variants take barcodes from its page: of the selected variant, of item numbers with a code, of any barcode."""
    variants = [v for v in product.get("variants") or [] if isinstance(v, dict)]
    if not variants:
        return product
    try:
        chosen = json.loads(balanced_object(page, '"selected_variant_drop"') or "null")
    except (ValueError, RecursionError):
        chosen = None
    if isinstance(chosen, dict):
        v = next((v for v in variants if str(v.get("id")) == str(chosen.get("id"))), variants[0])
        v["barcode"], v["sku"] = _code(chosen.get("barcode") or v.get("barcode")), chosen.get("sku") or v.get("sku") or ""
    for sku, mpn in re.findall(r'"sku"\s*:\s*"([^"]*)"[\s\S]{0,400}?"mpn"\s*:\s*"([^"]*)"', page):
        v = next((v for v in variants if v.get("sku") == squeeze(sku)), variants[0])
        if _code(mpn) and not v.get("barcode"):
            v["barcode"] = _code(mpn)
    codes = (c for s in re.findall(r'"barcode"\s*:\s*"([^"]{8,32})"', page) if (c := _code(s)))
    if not variants[0].get("barcode") and (c := next(codes, "")):
        variants[0]["barcode"] = c
    return product


def fill_feed(feed: DataFrame, pages: DataFrame) -> DataFrame:
    """Feed products (ord, root, body) whose variants take barcodes from their pages (url, html); products without a page stay."""
    url = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/products/"), F.get_json_object("body", "$.handle"))
    both = feed.withColumn("url", url).join(pages.groupBy("url").agg(F.first("html").alias("html")), "url", "left").select("ord", "root", "body", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, html in zip(b.column("body").to_pylist(), b.column("html").to_pylist(), strict=True):
                try:
                    product = json.loads(body or "") if html else None
                except (ValueError, RecursionError):
                    product = None
                out.append(json.dumps(fill_variants(product, html)) if isinstance(product, dict) else body)
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("root"), pa.array(out, pa.string())], ["ord", "root", "body"])

    return both.mapInArrow(run, "ord long, root string, body string")


# The spellings of a hosted payload's fields.
HOSTED = {
    "product_name": ["product_name", "name", "title"], "brand": ["brand"], "sku": ["sku", "item_number", "itemNumber"], "upc": ["upc"], "ean": ["ean"], "gtin": ["gtin"], "price": ["price"],
    "pack_size": ["pack_size", "packSize"], "case_pack": ["case_pack", "casePack"], "image_url": ["image_url", "imageUrl"], "product_url": ["product_url", "productUrl", "url"],
}
SUMMARY = r"(?i)^\d[\d,]*\s+(?:results?|items?|products?)\s+for\b"


def product_lists(value) -> Iterator[dict]:
    """The objects of every `products` list of a payload, outer lists first."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield from (p for p in (x["products"] if isinstance(x.get("products"), list) else []) if isinstance(p, dict))
            todo += [v for v in reversed(list(x.values())) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            todo += [v for v in reversed(x) if isinstance(v, (dict, list))]


def hosted_rows(payloads: DataFrame) -> DataFrame:
    """Product rows of hosted payloads (page_id, url, body: JSON with data.markdown and data.links): of its product lists and
    its markdown cards, merged by key; a payload without any gives rows of its links."""
    fields = list(HOSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, url, body in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body")), strict=True):
                try:
                    value = json.loads(body or "")
                except (ValueError, RecursionError):
                    continue
                for k, x in enumerate(product_lists(value)):
                    r = {f: str(next((x[n] for n in names if x.get(n)), "")) for f, names in HOSTED.items()}
                    r |= {f: resolve(url or "", r[f]) for f in ("image_url", "product_url")}
                    if r["product_name"].strip() and not re.search(SUMMARY, r["product_name"].strip()):
                        rows.append((page, k, *(r[f] for f in fields)))
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.string()] * len(fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "at", *fields])

    listed = payloads.select("page_id", "url", "body").mapInArrow(run, "page_id long, at int, " + ", ".join(f"{f} string" for f in fields))
    key = first_present("product_url", "sku", F.concat_ws("|", F.trim("product_name"), "price"))
    listed = first_of_each(listed.withColumn("ord", F.struct("page_id", F.lit(0).alias("part"), F.col("at").alias("n"))).drop("at"), F.concat_ws(" ", "page_id", key))
    cards = markdown_cards(payloads.withColumn("body", F.get_json_object("body", "$.data.markdown")).where("body is not null"))
    cards = cards.withColumn("ord", F.struct("page_id", F.lit(1).alias("part"), F.col("ord").alias("n")))
    every = listed.unionByName(cards.select("page_id", "ord", *(F.col(f) if f in cards.columns else F.lit("").alias(f) for f in fields)))
    # the merge's key counts within a payload
    merged = dedup_merge_within(every, "page_id")
    links = payloads.select("page_id", "url", F.from_json(F.get_json_object("body", "$.data.links"), "array<string>").alias("links")).where("links is not null")
    bare = link_rows(links.join(merged.select("page_id").distinct(), "page_id", "left_anti"))
    bare = bare.select("page_id", F.struct("page_id", F.lit(2).alias("part"), F.col("ord").alias("n")).alias("ord"), *(F.col(f) if f in bare.columns else F.lit("").alias(f) for f in fields))
    return ids.normalize_products(merged.unionByName(bare))


def dedup_merge_within(df: DataFrame, group: str) -> DataFrame:
    """`dedup_merge` in each group alone."""
    rest = [c for c in df.columns if c not in ("ord", group)]
    first = [F.coalesce(F.min(F.when(F.col(c) != "", F.struct("ord", c)))[c], F.lit("")).alias(c) for c in rest]
    return df.groupBy(group, single_key().alias("_key")).agg(F.min("ord").alias("ord"), *first).select(df.columns)

