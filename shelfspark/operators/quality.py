"""Quality reports over product rows: counts, coverage, warnings with penalties, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and URLs that are no product.
NON_PRODUCT_NAMES = r"(?i)\byour shopping cart\b|\bshopping cart\b|\bsign\s*in\b|\blog\s*in\b|\bjavascript is disabled\b|\bsearch instead\b|^\s*showing results for|^\s*\d[\d,]*\s+(?:results?|items?|products?)\s+for\b"
NON_PRODUCT_URLS = r"(?i)/basket|/cart|/checkout|/account|/myaccount|/users/|/login|/register|/signin|/signup|/wishlist"


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def has_identifier(df: DataFrame, *fields: str) -> Column:
    out = F.lit(False)
    for c in fields or ("upc", "ean", "gtin", "gtin_case"):
        if c in df.columns:
            out = out | _has(c)
    return out


def price_modes(df: DataFrame, by: list[str]) -> DataFrame:
    """For each group the number of priced rows and the most common price, the first seen on ties."""
    per_price = df.where(_has("price")).groupBy(*by, "price").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max_by(F.struct("price", "n"), F.struct(F.col("n"), (-F.col("first")).alias("f")))
    return per_price.groupBy(*by).agg(F.sum("n").alias("priced"), best.alias("_best")).select(*by, "priced", F.col("_best.price").alias("mode_price"), F.col("_best.n").alias("mode_count"))


def quality_report(df: DataFrame, by: list[str], expected_products: Column | None = None, expected_pages: Column | None = None, pages_visited: Column | None = None, stop_reason: Column | None = None) -> DataFrame:
    """One row for each group: seven counts, warnings and a score from 0 to 1.

    The expectations are columns of the groups (literals, or attributes of `by`).
    """
    name, url = F.coalesce(F.col("product_name"), F.lit("")), F.coalesce(F.col("product_url"), F.lit(""))
    n = lambda ok: F.count_if(ok)
    counted = df.groupBy(*by).agg(
        F.count("*").alias("products"), n(_has("product_name")).alias("name"), n(_has("price")).alias("price"), n(_has("sku")).alias("sku"),
        n(has_identifier(df)).alias("barcode"), n(_has("product_url")).alias("product_url"), n(_has("image_url") if "image_url" in df.columns else F.lit(False)).alias("image_url"),
        n(name.rlike(NON_PRODUCT_NAMES) | url.rlike(NON_PRODUCT_URLS)).alias("non_product"),
    )
    # null groups have modes too; without groups both sides are one row
    modes = price_modes(df, by).select(*(F.col(c).alias(f"_m_{c}") for c in by), "priced", "mode_price", "mode_count")
    same = F.lit(True)
    for c in by:
        same = same & counted[c].eqNullSafe(modes[f"_m_{c}"])
    r = counted.join(modes, same, "left").drop(*(f"_m_{c}" for c in by))
    total, share = F.col("products"), lambda c: F.col(c) / F.col("products")
    some = total > 0
    odd = (F.col("priced") >= 6) & (F.col("mode_count") / F.col("priced") > 0.80)
    checks: list[tuple[Column, Column, float]] = [
        (F.col("non_product") > 0, F.concat(F.col("non_product"), F.lit(" extracted row(s) look like navigation, account, cart, or search/category summaries.")), 0.35),
        (total < 3, F.lit("Very few products were extracted; this may be a detail page, search shell, or incomplete catalog crawl."), 0.20),
        (share("name") < 0.70, F.lit("Low product-name coverage; card/row detection may be wrong."), 0.20),
        (share("product_url") < 0.30, F.lit("Few product detail URLs were found; detail enrichment may be limited."), 0.20),
        ((F.col("price") == 0) & (F.col("sku") == 0) & (F.col("barcode") == 0), F.lit("No price, SKU, or UPC/EAN/GTIN fields were captured; extracted rows are likely not real products or require a browser/login session."), 0.35),
        (share("barcode") < 0.20, F.lit("Low UPC/EAN/GTIN coverage; identifiers may live on detail pages or behind login."), 0.15),
        (odd, F.concat(F.lit("Price anomaly: "), F.col("mode_count"), F.lit("/"), F.col("priced"), F.lit(" rows share "), F.col("mode_price"), F.lit(".")), 0.20),
    ]
    if expected_pages is not None and pages_visited is not None:
        checks.append(((expected_pages > 0) & (pages_visited > 0) & (pages_visited < expected_pages), F.concat(F.lit("Pagination may be incomplete: visited "), pages_visited, F.lit("/"), expected_pages, F.lit(" pages.")), 0.25))
    if expected_products is not None:
        checks.append(((expected_products > 0) & (total < expected_products) & (total / expected_products < 0.90), F.concat(F.lit("Catalog may be incomplete: captured "), total, F.lit("/"), expected_products, F.lit(" visible products.")), 0.20))
    if stop_reason is not None:
        normal = stop_reason.startswith("all ") | stop_reason.startswith("navigation exhausted after") | stop_reason.startswith("crawl stopped after")
        checks.append(((stop_reason != "") & ~normal, F.concat(F.lit("Stop reason: "), stop_reason), 0.10))
    holds = [F.coalesce(ok & some, F.lit(False)) for ok, _, _ in checks]
    warnings = F.array_compact(F.array(*(F.when(ok, text) for ok, (_, text, _) in zip(holds, checks, strict=True))))
    lost = F.lit(0.0)
    for ok, (_, _, penalty) in zip(holds, checks, strict=True):
        lost = lost + F.when(ok, penalty).otherwise(0.0)
    score = F.when(some, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - lost)), 2)).otherwise(0.0)
    keep = ["products", "name", "price", "sku", "barcode", "product_url", "image_url"]
    return r.select(*by, *keep, F.when(some, warnings).otherwise(F.array(F.lit("No products were extracted."))).alias("warnings"), score.alias("score"))


def coverage(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """The share of rows that have each field, to three places."""
    share = lambda ok: F.bround(F.count_if(ok) / F.count("*"), 3)
    return df.groupBy(*by).agg(*(share(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(f"{c}_coverage") for c in fields), share(has_identifier(df)).alias("barcode_coverage"))


def run_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, rows with identifier, rows with item number, distinct brands, distinct categories of '; ' lists."""
    parts = F.filter(F.split(F.coalesce(F.col("category"), F.lit("")), "; "), lambda x: x != "")
    base = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(has_identifier(df)).alias("with_identifier"), F.count_if(_has("sku")).alias("with_sku"), F.countDistinct(F.nullif("brand", F.lit(""))).alias("brands"))
    cats = df.select(*by, F.explode(parts).alias("c")).groupBy(*by).agg(F.countDistinct("c").alias("categories"))
    return base.join(cats, by, "left").withColumn("categories", F.coalesce("categories", F.lit(0)))


STATUSES = ["pass", "partial", "fail", "blocked", "timeout", "error"]


def benchmark_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, mean score and time, share of passes."""
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.bround(F.avg("quality_score"), 3).alias("avg_quality_score"), F.bround(F.avg("elapsed_seconds"), 2).alias("avg_elapsed_seconds"),
        F.bround(F.count_if(F.col("status") == "pass") / F.count("*"), 3).alias("pass_rate"),
    )


def recovery_needed(df: DataFrame, by: list[str], expected: Column) -> DataFrame:
    """Whether a run wants another try: fewer than nine tenths of the rows expected, or barcodes on less than three quarters."""
    r = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(has_identifier(df, "upc", "ean", "gtin")).alias("barcodes"))
    return r.withColumns({"barcode_share": F.col("barcodes") / F.col("rows"), "recover": ((expected > 0) & (F.col("rows") < expected * 0.9)) | (F.col("barcodes") / F.col("rows") < 0.75)})


def strongest(results: DataFrame, by: list[str]) -> DataFrame:
    """The result of most rows, then most barcodes, then the best coverage; the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("rows"), F.desc("barcodes"), F.desc("barcode_share"), "ord")
    return results.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
