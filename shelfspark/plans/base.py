"""Product rows derived from the star schema, once for Spark and once as SQL text of both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sparse rows with unique keys, one for each part.
CATALOG = {
    "ord": "p_partkey",
    "product_name": "p_name",
    "brand": "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END",
    "sku": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('SKU-', cast(p_partkey AS string)) END",
    "upc": "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN concat(' ', substr(lpad(cast(p_partkey * 7919 AS string), 12, '0'), 1, 1), '-', substr(lpad(cast(p_partkey * 7919 AS string), 12, '0'), 2), ' ') ELSE lpad(cast(p_partkey * 7919 AS string), 12 + cast(p_partkey % 3 AS int), '0') END",
    "ean": "CASE WHEN p_partkey % 10 = 0 THEN lpad(cast(p_partkey AS string), 13, '4') ELSE '' END",
    "gtin": "CASE WHEN p_partkey % 20 = 5 THEN lpad(cast(p_partkey AS string), 14, '1') ELSE '' END",
    "gtin_case": "CASE WHEN p_partkey % 4 = 0 THEN lpad(cast(p_partkey * 7919 AS string), 14, '0') ELSE '' END",
    "price": "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('$', cast(cast(p_size * 10 AS decimal(12,2)) AS string)) END",
    "category": "p_type",
    "pack_size": "CASE WHEN p_partkey % 2 = 0 THEN concat(cast(p_size AS string), ' OZ') ELSE '' END",
    "case_pack": "CASE WHEN p_partkey % 7 = 0 THEN '12' ELSE '' END",
    "unit_size": "CASE WHEN p_partkey % 6 = 1 THEN concat(cast(p_size AS string), ' OZ') ELSE '' END",
    "image_url": "concat('https://img.example/', cast(p_size AS string), '.jpg')",
    "product_url": "CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('https://shop.example/products/', cast(p_partkey AS string), CASE WHEN p_partkey % 8 = 0 THEN '/' ELSE '' END) END",
}
#: Rows with many duplicates, one for each order.
FEED = {
    "ord": "o_orderkey",
    "run": "o_orderstatus",
    "product_name": "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Item ', cast(o_custkey % 211 AS string)) END",
    "brand": "o_orderpriority",
    "sku": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('SKU-', cast((o_custkey * 31 + o_orderkey % 7) % 997 AS string)) END",
    "upc": "CASE WHEN o_custkey % 4 = 0 THEN lpad(cast(o_custkey AS string), 12, '0') ELSE '' END",
    "price": "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('$', cast(cast(o_custkey % 50 AS decimal(12,2)) AS string)) END",
    "image_url": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('https://img.example/', cast(o_custkey % 101 AS string), '.png') END",
    "product_url": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('https://shop.example/p/', cast((o_custkey * 17 + o_orderkey % 3) % 1500 AS string)) END",
}
#: Detail rows, several for some URLs.
DETAIL = {
    "ord": "c_custkey",
    "product_name": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('Detail ', c_name) END",
    "brand": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END",
    "sku": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('SKU-', cast(c_custkey AS string)) END",
    "upc": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lpad(cast(c_custkey * 104729 AS string), 12, '0') END",
    "price": "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('$', cast(cast(c_nationkey AS decimal(12,2)) AS string)) END",
    "product_url": "concat('https://shop.example/products/', cast(c_custkey % 1200 AS string))",
}
_FROM = {"catalog": ("part", CATALOG), "feed": ("orders", FEED), "detail": ("customer", DETAIL)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that `dealt` spreads rows over.
TASKS_A_CORE = 4


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """`rows` spread over the cluster by a key, before each is made into a page or a payload.

    A few MB of a compressed file hold a million rows: its few tasks would do all the work, and its size on disk tells
    nothing of what is made of it, so no join takes it (or what comes of it) for small enough to be broadcast.
    """
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, key).hint("merge")


def rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """catalog, feed or detail; only the columns that a plan uses are read."""
    source, columns = _FROM[kind]
    return load(spark, sf_dir, source).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql(kind: str) -> str:
    """The same rows as a subquery."""
    source, columns = _FROM[kind]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


def values(table: list[tuple], names: list[str]) -> str:
    """Inline rows for SQL."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in table) + f") t({', '.join(names)})"
