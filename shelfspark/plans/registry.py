"""What others can plug in: providers, strategies, fetchers and extractors; and the functions that SQL may call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import first_tier
from ..sources.nodes import parse

#: (products) -> candidates (ord, position, title, brand, pack_size, case_pack, upc)
Provider = Callable[[DataFrame], DataFrame]
#: (pages) -> product rows with page_id
Strategy = Callable[[DataFrame], DataFrame]


class Providers:
    """Named sources of candidates, asked in the order they were added."""

    def __init__(self) -> None:
        self.known: dict[str, Provider] = {}

    def add(self, name: str, lookup: Provider) -> None:
        if name in self.known:
            raise ValueError(f"there is a provider {name} already")
        self.known[name] = lookup

    def candidates(self, products: DataFrame, routes: DataFrame | None = None) -> DataFrame:
        """The candidates of all providers; with `routes` (ord, provider, position) each product asks those of its route alone."""
        out = None
        for place, (name, lookup) in enumerate(self.known.items()):
            asked = products
            if routes is not None:
                asked = products.join(routes.where(F.col("provider") == name).select("ord"), "ord", "left_semi")
            found = lookup(asked).withColumns({"provider": F.lit(name), "provider_position": F.lit(place)})
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        if out is None:
            raise ValueError("no provider was added")
        return out


class Strategies:
    """Named extractors of product rows, in order of preference."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[str, Strategy]] = {}

    def add(self, number: int, name: str) -> Callable[[Strategy], Strategy]:
        def put(f: Strategy) -> Strategy:
            if number in self.known:
                raise ValueError(f"there is a strategy {number} already")
            self.known[number] = (name, f)
            return f

        return put

    def run(self, number: int, pages: DataFrame) -> DataFrame:
        name, f = self.known[number]
        return f(pages).withColumns({"strategy_id": F.lit(number), "strategy_name": F.lit(name)})

    def best(self, pages: DataFrame) -> DataFrame:
        """The rows of each page's first strategy that finds any."""
        every = None
        for number in sorted(self.known):
            rows = self.run(number, pages)
            every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        if every is None:
            raise ValueError("no strategy was added")
        return first_tier(every, "page_id", "strategy_id")


def default_strategies() -> Strategies:
    """Structured data, then labelled rows, then cards."""
    from ..operators import cards, layouts, structured
    from ..sources.nodes import nodes

    out = Strategies()
    out.add(1, "structured data")(lambda pages: structured.structured(pages, nodes(pages)).drop("tier"))
    out.add(2, "labelled rows")(layouts.layout_rows)
    out.add(3, "cards")(cards.listing_cards)
    return out


def fetched(links: DataFrame, pages: DataFrame, url: str = "product_url") -> DataFrame:
    """The stored pages of links: what a fetching function is for one of them."""
    return links.join(pages.select(F.col("url").alias(url), "page_id", "html"), url)


class PageNodes:
    """A table function: the elements of one page's HTML."""

    def eval(self, html: str) -> Iterator[tuple]:
        found, pieces = parse(html or "")
        for n in found:
            yield n["id"], n["parent"], n["depth"], n["tag"], n["attrs"].get("class", ""), n["own_text"], " ".join(pieces[slice(*n["said"])])


NODE_ROWS = "node_id int, parent_id int, depth int, tag string, class string, own_text string, text string"


def register(spark: SparkSession) -> list[str]:
    """Make functions known to SQL; returns their names."""
    from ..functions.plain import clean_title, code_digits, is_category_name
    from ..functions.url import feed_bases, looks_like_product, page_variants

    def text(f: Callable[[str], object], kind: T.DataType):
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: f(x or ""))

        return run

    made = {
        "clean_title": text(clean_title, T.StringType()), "code_digits": text(code_digits, T.StringType()), "is_category_name": text(is_category_name, T.BooleanType()),
        "looks_like_product": text(looks_like_product, T.BooleanType()), "feed_bases": text(feed_bases, T.ArrayType(T.StringType())), "next_page_urls": text(lambda u: page_variants(u, 2), T.ArrayType(T.StringType())),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("page_nodes", F.udtf(PageNodes, returnType=NODE_ROWS))
    return [*made, "page_nodes"]

