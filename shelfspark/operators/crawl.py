"""Listings over several pages, from pages that are stored already: what comes next is a join with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import page_variants, pagination, stable_sort
from ..sources.dom import Page, host, per_page, resolve
from .dedup import first_of_each
from .targets import product_links

# Texts of links to the next page, and marks of the elements that hold them.
NEXT_TEXTS = ["next", "next page", "\u203a", "\u00bb", ">>", "next \u00bb", "next>", ">"]
NEXT_PARTS = ["next", "\u203a", "\u00bb"]
PAGERS = ["pagination", "pager", "pages", "page-nav", "paginate"]
MOST_PAGES = 100


def next_candidates(page: Page, url: str) -> list[str]:
    """Where the next page may be, best first: rel=next, a label, a text inside a pager (anywhere if there is none)."""

    def hrefs() -> Iterator[str]:
        for k in page.all("a", "link"):
            if "next" in page.attr(k, "rel").lower().split():
                yield page.attr(k, "href")
        links = [a for a in page.all("a") if page.attr(a, "href")]
        yield from (page.attr(a, "href") for a in links if "next" in page.attr(a, "aria-label").lower())
        pagers = [i for i in page.all("nav", "div", "ul", "ol", "section") if page.marked(i, PAGERS)]
        for scope in pagers or [-1]:
            inner = page.below(scope)
            yield from (page.attr(a, "href") for a in links if a in inner and ((t := page.text(a, "").lower()) in NEXT_TEXTS or any(p in t for p in NEXT_PARTS)))

    found = (resolve(url, h) for h in hrefs() if h and not h.startswith(("#", "javascript")))
    return list(dict.fromkeys(u for u in found if host(u) == host(url)))


def hops(pages: DataFrame) -> DataFrame:
    """(url, page_id, candidates, total_products, total_pages): what each stored page says about the pages after it; further columns stay."""

    def rows_of(page: Page, url: str, *kept) -> Iterator[tuple]:
        numbers = {int(t) for i in page.all("a", "button", "span", "li") if (t := page.text(i)).isdigit() and len(t) <= 5 and any(page.marked(k, PAGERS) for k in page.up(i))}
        yield url, next_candidates(page, url), max(numbers) if len(numbers) >= 2 else None, page.text(), *kept

    kept = tuple(c for c in pages.columns if c not in ("page_id", "url", "html"))
    types = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in kept)
    found = per_page(pages, f"url string, candidates array<string>, highest int, said string{types}", rows_of, kept)
    said = pagination(F.col("said"), F.col("highest"))
    return found.select("page_id", "url", "candidates", said["total_products"].alias("total_products"), said["per_page"].alias("per_page"), said["total_pages"].alias("total_pages"), *kept)


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("a crawl writes its steps to the folder that spark.checkpoint.dir names")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")  # pages compress well: the size of the files tells little


@F.pandas_udf(T.ArrayType(T.StringType()))
def _numbered(url: pd.Series, target: pd.Series, per_page: pd.Series) -> pd.Series:
    """`page_urls` of the URLs that aren't null."""
    return pd.Series([None if u is None else page_variants(u, int(t), None if pd.isna(n) else int(n)) for u, t, n in zip(url, target, per_page, strict=True)], dtype=object)


def visits(starts: DataFrame, pages: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """(crawl, page_num, url, page_id, stop_reason): the pages that each start (crawl, url) reaches, one after another.

    The next page is the first candidate not visited yet; without one, the page's number in the URL while fewer pages
    than the first one promises were seen. A page that isn't stored ends the crawl, and so does `most` (null: none).
    A collection that sorts unstably starts at its stable order, if that is stored. Each step joins the crawls' last
    pages, a row each, with what the stored pages say, once; its rows are written to the shared folder.
    """
    said = hops(pages.withColumn("stable", stable_sort(F.col("html"), F.col("url"))))
    told = ["page_id", "candidates", "total_products", "per_page", "total_pages", "stable"]
    # one row for each URL, and nothing of its page but what the steps use
    one = _stored(said.groupBy("url").agg(F.min_by(F.struct(*told), "page_id").alias("h")), "hops")
    began = _stored(starts.join(one, "url").select("crawl", "url", "h"), "starts")
    there = one.select(F.col("url").alias("stable"), F.col("h").alias("there"))
    moved = began.where("h.stable <> url").withColumn("stable", F.col("h.stable")).join(there, "stable", "left")
    moved = moved.select("crawl", F.when(F.col("there").isNotNull(), F.col("stable")).otherwise(F.col("url")).alias("url"), F.coalesce("there", "h").alias("h"))
    began = began.where("h.stable = url").unionByName(moved)
    front = began.select("crawl", "url", F.lit(1).alias("page_num"), F.array("url").alias("seen"), F.col("h.total_pages").alias("expected"), F.col("h.per_page").alias("per_page"), "h")
    done: DataFrame | None = None
    step, more_to_see = 1, True
    while more_to_see:
        capped = most is not None and step >= most
        unseen = F.get(F.filter("h.candidates", lambda u: ~F.array_contains("seen", u)), 0)
        # only rows that need a number in their URL have one worked out
        more = F.col("first").isNull() & F.col("expected").isNotNull() & (F.col("page_num") < F.col("expected"))
        asked = front.withColumn("first", unseen)
        guessed = F.filter(_numbered(F.when(more, F.col("url")), F.col("page_num") + 1, F.col("per_page")), lambda u: ~F.array_contains("seen", u))
        asked = asked.withColumn("found", F.coalesce("first", F.when(more, F.get(guessed, 0)))).drop("first")
        asked = asked.withColumn("next", F.lit(None).cast("string") if capped else F.col("found"))
        # a step's table holds what its pages say and what the pages after them say: rows and the next step read it, and join nothing more
        taken = asked.join(one.select(F.col("url").alias("next"), F.col("h").alias("after")), "next", "left") if not capped else asked.withColumn("after", F.lit(None).cast(one.schema["h"].dataType))
        at = _stored(taken, "step")
        reason = (
            F.when(F.col("after").isNotNull(), F.lit(None).cast("string")).when(F.lit(capped) & F.col("found").isNotNull(), f"max page cap reached ({most})")
            .when(F.col("next").isNotNull(), F.concat(F.lit("page not stored: "), F.col("next"))).otherwise(exhausted_reason(F.col("expected"), F.col("page_num")))
        )
        rows = at.select("crawl", "page_num", "url", F.col("h.page_id").alias("page_id"), reason.alias("stop_reason"), "expected")
        done = rows if done is None else done.unionByName(rows)
        after = at.where("after is not null")
        more_to_see = bool(after.limit(1).count())
        front = after.select("crawl", F.col("next").alias("url"), (F.col("page_num") + 1).alias("page_num"), F.concat("seen", F.array("next")).alias("seen"), "expected", "per_page", F.col("after").alias("h"))
        step += 1
    return done


def exhausted_reason(expected: Column, page_num: Column) -> Column:
    """Why a crawl that found no further page stopped."""
    n, all_pages = page_num.cast("string"), expected.cast("string")
    return (
        F.when(expected.isNull() | (expected == 0), F.concat(F.lit("navigation exhausted after page "), n))
        .when(page_num > expected, F.concat(F.lit("navigation exhausted after "), n, F.lit(" page(s); detected estimate was "), all_pages))
        .when(page_num < expected, F.concat(F.lit("no navigation path found after page "), n))
        .otherwise(F.concat(F.lit("all "), all_pages, F.lit(" expected page(s) visited; no further navigation found")))
    )


def enrichment_cap(total_products: Column, total_pages: Column, visited: Column, candidates: Column) -> Column:
    """How many detail pages a crawl reads at most: the promised products, if more links were found in no more pages than promised; else null."""
    total = F.when(total_products > 0, total_products)
    return F.when(candidates > total, F.when(~F.coalesce((total_pages > 0) & (visited > total_pages), F.lit(False)), total))


def crawl_products(visited: DataFrame, pages: DataFrame, extract: Callable[[DataFrame], DataFrame], keys: list[Column]) -> DataFrame:
    """The rows that `extract` gives for the visited pages, in crawl order, each key's first row of a crawl only."""
    return _placed(visited, extract(pages.join(visited.select("page_id").distinct().hint("merge"), "page_id", "left_semi")), keys)


def _placed(visited: DataFrame, rows: DataFrame, keys: list[Column]) -> DataFrame:
    # neither side is ever broadcast: what a page gives can't be told from the size of its input
    placed = rows.hint("merge").join(visited.select("crawl", "page_num", "page_id"), "page_id").withColumn("ord", F.struct("crawl", "page_num", "ord"))
    for key in keys:  # a key counts within its crawl
        placed = first_of_each(placed, F.when(key != "", F.concat_ws(" ", F.col("crawl"), key)))
    return placed.withColumn("ord", F.col("ord.ord"))


def crawl_links(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl, page_num, ord, product_url, alternatives): the product links of a crawl's pages, each where it is met first.

    Links are taken where the pages stand, and only they meet the visits: no page is moved.
    """
    return _placed(visited, product_links(pages), [F.col("product_url")]).select("crawl", "page_num", "ord", "product_url", "alternatives")
