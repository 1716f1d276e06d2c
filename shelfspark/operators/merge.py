"""Keyed merges: what dictionaries and nested loops do elsewhere, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import detail_features, detail_match
from ..schema import first_present, present

# Columns that a listing row and a detail row are merged on.
MERGED = [
    "product_name", "brand", "sku", "upc", "price", "pack_size", "case_pack", "image_url", "product_url", "unit_size", "unit_price", "pricing_unit",
    "bulk_price", "minimum_order_qty", "raw_price_text", "gtin_case", "ean", "gtin", "barcode_raw", "identifier_type",
]
FROM_MODEL = ["product_name", "brand", "sku", "upc", "ean", "gtin", "price", "pack_size", "case_pack", "image_url", "product_url"]


def _sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join in which the right side's columns are called d_<name>; the right side has one row for each key, the first."""
    names = [c for c in right.columns if c != key]
    one = right.where(F.col(key) != "").groupBy(key).agg(F.first(F.struct(*names)).alias("_d")) if "ord" not in names else right.where(F.col(key) != "").groupBy(key).agg(F.min_by(F.struct(*names), "ord").alias("_d"))
    return left.join(one.select(F.col(key), *(F.col(f"_d.{c}").alias(f"d_{c}") for c in names)), key, "left")


def _merge(left: DataFrame, right: DataFrame, key: str, rule) -> DataFrame:
    both = _sided(left, right, key)
    return both.select(*((rule(c).alias(c) if c != key and f"d_{c}" in both.columns and c != "ord" else F.col(c)) for c in left.columns))


def enrich_detail_wins(listing: DataFrame, detail: DataFrame, key: str = "product_url") -> DataFrame:
    """Detail fields that aren't empty replace the listing's; the key stays."""
    return _merge(listing, detail, key, lambda c: first_present(f"d_{c}", c))


def backfill_listing_wins(listing: DataFrame, detail: DataFrame, key: str = "product_url") -> DataFrame:
    """Only empty listing fields take the detail's; upc_source tells where a new upc comes from."""
    both = _sided(listing.withColumn("_had", F.col("upc") != ""), detail, key)
    source = F.when(~F.col("_had") & present("d_upc").isNotNull(), "detail_upc").otherwise(F.col("upc_source") if "upc_source" in listing.columns else F.lit(""))
    fields = [first_present(c, f"d_{c}").alias(c) if f"d_{c}" in both.columns and c not in (key, "ord", "upc_source") else F.col(c) for c in listing.columns if c != "upc_source"]
    return both.select(*fields, source.alias("upc_source"))


def merge_from_model(rows: DataFrame, detail: DataFrame, key: str = "product_url") -> DataFrame:
    """Model rows fill what is empty, but their identifiers always replace."""
    rule = lambda c: first_present(f"d_{c}", c) if c in ("upc", "ean", "gtin") else first_present(c, f"d_{c}")
    return _merge(rows, detail, key, lambda c: rule(c) if c in FROM_MODEL else F.col(c))


def append_missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """`rows` and those of `others` whose key isn't among them."""
    return rows.unionByName(others.join(rows.select(key).distinct(), key, "left_anti").select(rows.columns))


def links_to_enrich(pool: DataFrame, listing: DataFrame, url: str = "product_url") -> DataFrame:
    """Pool links that the listing has, if any; else the pool; else the listing."""
    both = pool.join(listing, url, "left_semi")
    tiers = both.withColumn("tier", F.lit(0)).unionByName(pool.withColumn("tier", F.lit(1))).unionByName(listing.select(pool.columns).withColumn("tier", F.lit(2)))
    least = tiers.agg(F.min("tier").alias("least"))  # one row
    return tiers.join(F.broadcast(least), F.col("tier") == F.col("least"), "left_semi").drop("tier").distinct()


def best_detail(listing: DataFrame, details: DataFrame, page: str, cap: int | None = None) -> DataFrame:
    """Each listing row's best detail row of its page: the highest score, the first on ties; without any score the first.

    What a row's fields tell is worked out once a row, before rows meet.
    """
    fields = ["product_name", "sku", "product_url", "upc", "ean", "gtin"]
    side = lambda df: df.select("ord", page, detail_features({c: F.col(c) if c in df.columns else F.lit("") for c in fields}).alias("f"))
    both = side(listing).alias("l").join(side(details).alias("d"), F.col(f"l.{page}") == F.col(f"d.{page}"))
    scored = both.select(F.col("l.ord").alias("ord"), F.struct(detail_match(F.col("l.f"), F.col("d.f")).alias("score"), (-F.col("d.ord")).alias("first")).alias("rank"), F.col("d.ord").alias("detail_ord"))
    best = scored.groupBy("ord").agg(F.max_by("detail_ord", "rank").alias("detail_ord"), F.max("rank")["score"].alias("score"))
    return best


def page_slice(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows from `offset` on, `limit` at most, in an order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered in `rank`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_tier(rows: DataFrame, page: str, tier: str = "tier") -> DataFrame:
    """The rows of each page's first tier that has any."""
    least = rows.groupBy(page).agg(F.min(tier).alias(tier))
    return rows.join(least, [page, tier], "left_semi")


def within_budget(rows: DataFrame, strength: Column, needs_lookup: Column, budget: int, groups: list[str]) -> DataFrame:
    """lookup: whether a row is looked up; the strongest of each group first, ties in order, until the budget is used.

    Only rows that need a lookup consume the budget, so those looked up are a group's first `budget` of them: tasks keep
    no more than that of any group, however large, and no window runs over a whole one.
    """
    marked = rows.withColumns({"_s": strength, "_n": needs_lookup})
    first = top_k(marked.where("_n").select(*groups, "ord", "_s"), groups, [F.desc("_s"), F.asc("ord")], budget).select("ord", F.lit(True).alias("_up"))
    status = F.when(~F.col("_n"), "not_needed").when(F.col("_up"), "looked_up").otherwise("external_lookup_skipped_budget")
    return marked.join(first, "ord", "left").withColumn("lookup_status", status).select(*rows.columns, "lookup_status")


def until_good_enough(scored: DataFrame, by: str, position: str, score: str, enough: int) -> DataFrame:
    """The best score of each product over its queries in order, up to the first that is good enough; the earlier wins ties."""
    per_query = scored.groupBy(by, position).agg(F.max(score).alias(score))
    w = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    tried = per_query.withColumn("_before", F.max(score).over(w)).where(F.col("_before").isNull() | (F.col("_before") < enough))
    best = F.max(F.struct(F.col(score), (-F.col(position)).alias("p")))
    return tried.groupBy(by).agg(best.alias("b"), F.count("*").alias("queries_tried")).select(by, F.col(f"b.{score}").alias(score), (-F.col("b.p")).alias(position), "queries_tried")
