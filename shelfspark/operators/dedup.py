"""First-wins deduplication. Every frame carries `ord`, a unique order of its rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import price_digits
from ..functions.text import name_key
from ..functions.url import url_key


def first_of_each(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key; rows with an empty or null key all stay.

    The least row of a key is an aggregate, so tasks reduce their own rows first and no key, however
    common, meets one task whole.
    """
    keyed = df.withColumn("_first_key", F.nullif(key, F.lit("")))
    rest = [c for c in df.columns if c != order]
    best = keyed.where("_first_key is not null").groupBy("_first_key").agg(F.min_by(F.struct(*rest), order).alias("_row"), F.min(order).alias(order)) if rest else keyed
    kept = best.select(*(F.col(f"_row.{c}").alias(c) if c != order else F.col(order) for c in df.columns))
    return kept.unionByName(keyed.where("_first_key is null").drop("_first_key"))


def cascade(df: DataFrame, tiers: Sequence[Column], order: str = "ord") -> DataFrame:
    """Tiers one after another: a key counts as soon as a row reaches its tier."""
    for key in tiers:
        df = first_of_each(df, key, order)
    return df


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _identity() -> Column:
    name = F.lower(_text("product_name"))
    return F.when(name != "", F.concat_ws("|", name, F.lower(_text("brand")), price_digits(F.col("price"))))


def dedup_listing(df: DataFrame) -> DataFrame:
    """By URL, then item number, then name, brand and price."""
    return cascade(df, [_text("product_url"), _text("sku"), _identity()])


def dedup_browser(df: DataFrame) -> DataFrame:
    """By URL, then name, brand and price, then image and name."""
    name, image = F.lower(_text("product_name")), _text("image_url")
    return cascade(df, [_text("product_url"), _identity(), F.when((name != "") & (image != ""), F.concat_ws("|", image, name))])


def single_key() -> Column:
    """URL, else item number, else name and price."""
    name = F.concat_ws("|", F.lower(_text("product_name")), _text("price"))
    return F.coalesce(F.nullif(url_key(_text("product_url")), F.lit("")), F.nullif(_text("sku"), F.lit("")), name)


def dedup_key(df: DataFrame) -> DataFrame:
    return first_of_each(df, single_key())


def dedup_merge(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each single key: every field is the first that isn't empty, in order."""
    rest = [c for c in df.columns if c != order]
    first = [F.coalesce(F.min(F.when(F.col(c) != "", F.struct(F.col(order), F.col(c))))[c], F.lit("")).alias(c) for c in rest]
    return df.groupBy(single_key().alias("_first_key")).agg(F.min(order).alias(order), *first).select(df.columns)


def ordered_union(first: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of the first frame before those of the second; `ord` becomes (frame, ord)."""
    tag = lambda d, i: d.withColumn(order, F.struct(F.lit(i).alias("part"), F.col(order).alias("at")))
    return tag(first, 0).unionByName(tag(second, 1), allowMissingColumns=True)


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("greedy deduplication writes its rounds to the folder that spark.checkpoint.dir names")
    return f"{base.rstrip('/')}/greedy-{uuid.uuid4().hex}"


def dedup_greedy(df: DataFrame, order: str = "ord") -> DataFrame:
    """By URL, item number, name and brand, where only accepted rows' keys count.

    Row by row this is sequential; in rounds it isn't: an undecided row that comes first for each of its keys is
    accepted, and undecided rows with a key of an accepted row go. Each round decides the first row of every key
    group at least, and its result is written to the shared folder.
    """
    spark = df.sparkSession
    name = F.when(name_key(F.coalesce(F.col("product_name"), F.lit(""))) != "", F.concat_ws("::", name_key(F.coalesce(F.col("product_name"), F.lit(""))), name_key(F.coalesce(F.col("brand"), F.lit("")))))
    keys = F.filter(F.array(F.concat(F.lit("u:"), F.nullif(_text("product_url"), F.lit(""))), F.concat(F.lit("s:"), F.nullif(_text("sku"), F.lit(""))), F.concat(F.lit("n:"), name)), lambda x: x.isNotNull())
    open_rows = df.select(F.col(order).alias("o"), keys.alias("keys"))
    accepted = open_rows.where(F.size("keys") == 0).select("o")
    open_rows = open_rows.where(F.size("keys") > 0)
    while True:
        path = _folder(spark)
        open_rows.write.parquet(path)
        open_rows = spark.read.parquet(path)
        if not open_rows.limit(1).count():
            break
        each = open_rows.select("o", F.explode("keys").alias("k"))
        least = each.groupBy("k").agg(F.min("o").alias("m"))
        won = each.join(least, "k").groupBy("o").agg(F.bool_and(F.col("o") == F.col("m")).alias("won")).where("won").select("o")
        path = _folder(spark)
        won.write.parquet(path)
        won = spark.read.parquet(path)
        accepted = accepted.unionByName(won)
        taken = each.join(won, "o", "left_semi").select("k").distinct()
        lost = each.join(taken, "k", "left_semi").select("o").distinct()
        open_rows = open_rows.join(lost, "o", "left_anti")
    return df.join(accepted.withColumnRenamed("o", order), order, "left_semi").select(df.columns)
