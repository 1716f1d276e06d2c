"""The query catalogue: a Spark plan and, where SQL can express it, its counterpart for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, money, pack, scoring, text, url
from ..operators import dedup, merge, quality
from ..schema import PRODUCT_FIELDS, conform
from . import base
from .base import rows, sql, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


# --- pieces of SQL -------------------------------------------------------------------------------------------------
C, FEED, DETAIL = sql("catalog"), sql("feed"), sql("detail")


def s_digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def s_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def s_barcode(c: str) -> str:
    return f"(CASE WHEN length({s_digits(c)}) BETWEEN 8 AND 14 THEN {s_digits(c)} ELSE '' END)"


def s_kind(d: str) -> str:
    return f"(CASE length({d}) WHEN 0 THEN '' WHEN 8 THEN 'ean8' WHEN 12 THEN 'upc' WHEN 13 THEN 'ean13' WHEN 14 THEN 'gtin14' ELSE 'barcode' END)"


def s_check(d: str) -> str:
    """Whether a string of digits is a valid GTIN."""
    total = f"list_sum(list_transform(range(1, length({d})), lambda i: CAST(substr({d}, CAST(i AS INT), 1) AS INT) * (CASE WHEN (length({d}) - 1 - i) % 2 = 0 THEN 3 ELSE 1 END)))"
    return f"(length({d}) IN (8, 12, 13, 14) AND len(list_distinct(string_split({d}, ''))) > 2 AND (10 - {total} % 10) % 10 = CAST(right({d}, 1) AS INT))"


def s_money(x: str) -> str:
    return f"format('${{:,.2f}}', {x})"


def s_key(c: str) -> str:
    """Lower case, punctuation as spaces, single spaces (ASCII)."""
    return s_squeeze(f"regexp_replace(lower({c}), '[^A-Za-z0-9_\\s]', ' ', 'g')")


def s_tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({s_key(c)}, ' '), lambda x: length(x) >= 2))"


def s_price_digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9.]', '', 'g')"


def s_url_key(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '#.*$', ''), '/+$', '')"


# --- identifiers and normalisation ---------------------------------------------------------------------------------
@query(
    "q_normalize_products",
    f"""WITH b AS (SELECT *, coalesce(nullif({s_barcode('upc')}, ''), nullif({s_barcode('ean')}, ''), nullif({s_barcode('gtin')}, ''), nullif({s_barcode('gtin_case')}, ''), '') AS code,
        CASE WHEN {s_barcode('upc')} <> '' THEN trim(upc) WHEN {s_barcode('ean')} <> '' THEN ean WHEN {s_barcode('gtin')} <> '' THEN gtin WHEN {s_barcode('gtin_case')} <> '' THEN gtin_case ELSE '' END AS raw FROM {C} c)
    SELECT ord, {s_squeeze('product_name')} AS product_name, CASE WHEN code <> '' AND trim(upc) = '' THEN code ELSE trim(upc) END AS upc,
        CASE WHEN code <> '' AND {s_kind('code')} LIKE 'ean%' AND ean = '' THEN code ELSE ean END AS ean, CASE WHEN code <> '' AND {s_kind('code')} LIKE 'gtin%' AND gtin = '' THEN code ELSE gtin END AS gtin,
        raw AS barcode_raw, {s_kind('code')} AS identifier_type FROM b""",
)
def normalize_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ids.normalize_products(rows(spark, sf_dir, "catalog").select("ord", "product_name", "upc", "ean", "gtin", "gtin_case"))
    return df.select("ord", "product_name", "upc", "ean", "gtin", "barcode_raw", "identifier_type")


@query("q_barcode_classify", f"SELECT {s_kind(s_barcode('upc'))} AS kind, CAST(count(*) AS BIGINT) AS n FROM {C} c GROUP BY 1")
def barcode_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = ids.barcode_kind(ids.barcode(F.col("upc")))
    return rows(spark, sf_dir, "catalog").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "q_check_digit",
    f"""WITH g AS (SELECT p_partkey AS ord, lpad(CAST(p_partkey * 7919 AS VARCHAR), 11, '0') AS body FROM part),
    d AS (SELECT ord, body, CAST((10 - list_sum(list_transform(range(1, 12), lambda i: CAST(substr(body, CAST(i AS INT), 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10 AS INT) AS digit FROM g)
    SELECT ord, digit, {s_check("concat(body, CAST(digit AS VARCHAR))")} AS valid, {s_check("concat(body, CAST((digit + 1) % 10 AS VARCHAR))")} AS flipped_valid FROM d""",
)
def check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lpad((F.col("p_partkey") * 7919).cast("string"), 11, "0")
    df = base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), body.alias("body")).withColumn("digit", ids.check_digit(F.col("body")))
    whole = lambda d: ids.has_valid_check_digit(F.concat("body", d.cast("string")))
    return df.select("ord", "digit", whole(F.col("digit")).alias("valid"), whole((F.col("digit") + 1) % 10).alias("flipped_valid"))


@query(
    "q_identity_resolve",
    f"""WITH d AS (SELECT ord, {s_digits('upc')} AS u, {s_digits('gtin_case')} AS g FROM {C} c), r AS (SELECT *, CASE WHEN u <> '' THEN u ELSE g END AS raw FROM d),
    k AS (SELECT *, CASE WHEN raw = '' THEN '' WHEN g <> '' AND raw = g THEN 'gtin_case' WHEN length(raw) = 12 THEN 'upc_12' WHEN length(raw) = 13 THEN 'gtin_13' WHEN length(raw) = 14 THEN 'gtin_14' WHEN length(raw) = 8 THEN 'gtin_8' ELSE 'unknown_numeric' END AS kind,
        length(u) = 12 AS native, length(u) = 14 AND u LIKE '00%' AS padded FROM r)
    SELECT ord, CASE WHEN native THEN u WHEN padded THEN substr(u, 3) ELSE '' END AS upc_12, kind AS native_identifier_type,
        CASE WHEN native THEN 'native_upc' WHEN padded THEN 'converted_padded_gtin14' WHEN u <> '' THEN kind ELSE 'missing_identifier' END AS identifier_status,
        CASE WHEN native OR padded THEN '0' ELSE '1' END AS needs_resolution, CASE WHEN native THEN 'native' WHEN padded THEN 'converted' ELSE 'needs_external_resolution' END AS resolution_status FROM k""",
)
def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ids.supplier_identity(F.col("upc"), F.col("gtin_case"))
    return rows(spark, sf_dir, "catalog").select("ord", r.alias("r")).select("ord", "r.upc_12", "r.native_identifier_type", "r.identifier_status", "r.needs_resolution", "r.resolution_status")


@query("q_conform", f"SELECT ord, {', '.join((c if c in base.CATALOG else chr(39) * 2) + ' AS ' + c for c in PRODUCT_FIELDS)} FROM {C} c")
def conform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(rows(spark, sf_dir, "catalog")).select("ord", *PRODUCT_FIELDS)


# --- money ---------------------------------------------------------------------------------------------------------
@query(
    "q_money_format",
    f"SELECT o_orderkey AS ord, {s_money('CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE)')} AS decimal_price, {s_money('CASE WHEN o_custkey > 999 THEN o_custkey / 100.0 ELSE CAST(o_custkey AS DOUBLE) END')} AS cents_price FROM orders",
)
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), money.money(F.col("o_totalprice").cast("decimal(12,2)")).alias("decimal_price"), money.money(F.col("o_custkey")).alias("cents_price"))


@query("q_minor_unit_money", f"SELECT p_partkey AS ord, {s_money('p_partkey * 10 / pow(10.0, p_size % 4)')} AS price FROM part")
def minor_unit_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money.minor_unit_money(F.col("p_partkey") * 10, F.col("p_size") % 4, F.lit("$"))
    return base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), price.alias("price"))


@query(
    "q_lowest_tier_price",
    f"SELECT ord, {s_money('least(CAST(p_size AS DOUBLE) + 1000, p_size * 2.5)')} AS lowest FROM (SELECT p_partkey AS ord, p_size FROM part)",
)
def lowest_tier_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("1+ $"), F.format_number(F.col("p_size") + 1000, 2), F.lit(" 10+ $"), F.format_number(F.col("p_size") * 2.5, 2))
    return base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), money.lowest_tier(cell).alias("lowest"))


# --- packs ---------------------------------------------------------------------------------------------------------
PACK_TEXT = """CASE p_partkey % 12 WHEN 0 THEN concat(n, '/1 GAL') WHEN 1 THEN concat(n, '/2.5LB') WHEN 2 THEN concat(n, '/32OZ') WHEN 3 THEN concat(n, '/EA') WHEN 4 THEN concat('5.7 OZ/', n, 'PK')
    WHEN 5 THEN concat(n, ' x 1 gal') WHEN 6 THEN concat(n, '-1gal') WHEN 7 THEN concat('case of ', n) WHEN 8 THEN concat(n, ' per case') WHEN 9 THEN concat('12.0 ml bottle ', n) WHEN 10 THEN concat('1 GAL EA, ', n, '/CS') ELSE concat('no pack ', n) END"""
PACKS = f"(SELECT p_partkey AS ord, {PACK_TEXT} AS t FROM (SELECT p_partkey, cast(p_size AS string) AS n FROM part))"


def s_pack(t: str, field: str) -> str:
    """One field of the pack grammar as a CASE over the layers."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    out = "CASE"
    units = "MAP {" + ", ".join(f"'{k.replace('_', ' ')}': '{v}'" for k, v in pack.UNITS.items() if k != "fl_oz") + "}"
    for method, p in pack.patterns().items():
        case, qty, un, sure = pack._LAYERS[method]
        get = lambda k, p=p: f"regexp_extract({t}, {quote(p)}, {k})"
        unit = f"coalesce({units}[translate(lower({get(un)}), '-_', '  ')], upper({get(un)}))" if un else "''"
        number = f"(CASE WHEN regexp_full_match({get(qty)}, '[0-9]+(\\.0+)?') THEN CAST(CAST({get(qty)} AS DECIMAL(18,4)) :: BIGINT AS VARCHAR) ELSE {get(qty)} END)" if qty else ""
        value = {
            "case_pack": get(case) if case else "''",
            "unit_measure": f"CASE WHEN {get(un)} = '' THEN '' ELSE {unit} END" if un else "''",
            "pack_size": f"trim(concat({number}, ' ', CASE WHEN {get(un)} = '' THEN '' ELSE {unit} END))" if qty else "''",
            "pack_confidence": f"'{sure}'" if sure else f"CASE WHEN {get(un)} = '' THEN 'medium' ELSE 'high' END",
            "pack_method": f"'{method}'",
        }[field]
        out += f" WHEN regexp_matches({t}, {quote(p)}) THEN {value}"
    return out + " ELSE '' END"


_PACK_FIELDS = ["case_pack", "pack_size", "unit_measure", "pack_confidence", "pack_method"]


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = base.load(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS string) AS n")
    return part.selectExpr("p_partkey AS ord", f"{PACK_TEXT} AS t")


@query("q_pack_parse", f"SELECT ord, {', '.join(f'{s_pack("t", f)} AS {f}' for f in _PACK_FIELDS)} FROM {PACKS} p")
def pack_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _packs(spark, sf_dir).withColumn("p", pack.parse_pack(F.col("t")))
    return df.select("ord", *(F.coalesce(F.col(f"p.{f}"), F.lit("")).alias(f) for f in _PACK_FIELDS))


@query(
    "q_pack_histogram",
    f"SELECT CASE WHEN c = '' THEN 'none' ELSE c END AS confidence, CAST(count(*) AS BIGINT) AS n FROM (SELECT {s_pack('t', 'pack_confidence')} AS c FROM {PACKS} p) GROUP BY 1",
)
def pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _packs(spark, sf_dir).select(F.lit("").alias("pack_size"), F.col("t").alias("case_pack"), F.lit("").alias("product_name"))
    return pack.enrich_pack(df).groupBy(F.coalesce(F.nullif("pack_confidence", F.lit("")), F.lit("none")).alias("confidence")).agg(F.count("*").alias("n"))


@query(
    "q_pack_title",
    f"""SELECT ord, {s_pack('t', 'case_pack')} AS case_pack, {s_pack('t', 'pack_size')} AS pack_size, CASE WHEN {s_pack('t', 'pack_confidence')} = 'high' THEN 'medium' ELSE {s_pack('t', 'pack_confidence')} END AS pack_confidence,
        CASE WHEN {s_pack('t', 'pack_method')} = '' THEN '' ELSE concat('title:', {s_pack('t', 'pack_method')}) END AS pack_method FROM (SELECT ord, CASE WHEN ord % 12 = 10 THEN split_part(t, ',', 1) ELSE t END AS t FROM {PACKS} p0) p""",
)
def pack_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Brand Widget | "), F.col("t"), F.lit(" ; blue"))
    df = _packs(spark, sf_dir).withColumn("p", pack.parse_pack_title(title))
    return df.select("ord", *(F.coalesce(F.col(f"p.{f}"), F.lit("")).alias(f) for f in ("case_pack", "pack_size", "pack_confidence", "pack_method")))


@query(
    "q_title_abbreviation",
    """SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, ' OZ') WHEN 1 THEN '' ELSE concat(p_size, ' CT') END AS unit_size, CASE p_partkey % 3 WHEN 2 THEN '' ELSE '6' END AS case_pack,
        CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.75 ELSE 0.6 END :: DOUBLE AS score FROM part""",
)
def title_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("Wipes - "), n, F.lit("oz/6pk"))).when(k == 1, F.lit("Pods 6pk")).otherwise(F.concat(F.lit("Cups "), n, F.lit("ct")))
    df = base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), pack.parse_title_abbreviation(title).alias("p"))
    return df.select("ord", "p.unit_size", "p.case_pack", F.col("p.pack_confidence_score").alias("score"))


# --- deduplication -------------------------------------------------------------------------------------------------
_IDENTITY = f"CASE WHEN trim(lower(product_name)) = '' THEN '' ELSE concat(trim(lower(product_name)), '|', trim(lower(brand)), '|', {s_price_digits('price')}) END"


def s_cascade(tiers: list[str]) -> str:
    steps = [f"t0 AS (SELECT * FROM {FEED} f)"]
    for i, k in enumerate(tiers):
        steps.append(f"k{i} AS (SELECT *, {k} AS k FROM t{i}), t{i + 1} AS (SELECT * EXCLUDE (k, rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM k{i}) WHERE k = '' OR rn = 1)")
    return f"WITH {', '.join(steps)} SELECT ord, product_name, sku, product_url FROM t{len(tiers)}"


@query("q_dedup_cascade", s_cascade(["product_url", "sku", _IDENTITY]))
def dedup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_listing(rows(spark, sf_dir, "feed")).select("ord", "product_name", "sku", "product_url")


@query("q_dedup_browser", s_cascade(["product_url", _IDENTITY, "CASE WHEN image_url = '' OR product_name = '' THEN '' ELSE concat(image_url, '|', lower(product_name)) END"]))
def dedup_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_browser(rows(spark, sf_dir, "feed")).select("ord", "product_name", "sku", "product_url")


_SINGLE = f"coalesce(nullif({s_url_key('product_url')}, ''), nullif(trim(sku), ''), concat(lower(trim(product_name)), '|', trim(price)))"


@query("q_key_dedup", f"SELECT ord, product_name, sku, product_url FROM (SELECT *, row_number() OVER (PARTITION BY {_SINGLE} ORDER BY ord) AS rn FROM {FEED} f) WHERE rn = 1")
def key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_key(rows(spark, sf_dir, "feed")).select("ord", "product_name", "sku", "product_url")


@query(
    "q_merge_dedup",
    f"SELECT min(ord) AS ord, {', '.join(f'coalesce(min_by({c}, ord) FILTER ({c} <> {chr(39) * 2}), {chr(39) * 2}) AS {c}' for c in ('product_name', 'brand', 'sku', 'upc', 'price', 'image_url', 'product_url'))} FROM {FEED} f GROUP BY {_SINGLE}",
)
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_merge(rows(spark, sf_dir, "feed").drop("run"))


@query("q_dedup_greedy")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature, so beyond SQL; the tests hold it against a loop."""
    return dedup.dedup_greedy(rows(spark, sf_dir, "feed")).select("ord", "product_name", "sku", "product_url")


@query(
    "q_ordered_union_dedup",
    f"""WITH u AS (SELECT 0 AS part, ord AS pos, product_url, sku FROM {FEED} f UNION ALL SELECT 1, ord, product_url, sku FROM {DETAIL} d),
    a AS (SELECT *, row_number() OVER (PARTITION BY product_url ORDER BY part, pos) AS rn FROM u), b AS (SELECT part, pos, product_url, sku, row_number() OVER (PARTITION BY sku ORDER BY part, pos) AS rn FROM a WHERE product_url = '' OR rn = 1)
    SELECT CAST(part AS INT) AS part, pos, product_url, sku FROM b WHERE sku = '' OR rn = 1""",
)
def ordered_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: rows(spark, sf_dir, k).select("ord", "product_url", "sku")
    both = dedup.ordered_union(pick("feed"), pick("detail"))
    return dedup.cascade(both, [F.col("product_url"), F.col("sku")]).select("ord.part", F.col("ord.at").alias("pos"), "product_url", "sku")


# --- quality -------------------------------------------------------------------------------------------------------
def s_quality(source: str, by: str) -> str:
    return f"""WITH s AS (SELECT * FROM {source} s0), m AS (SELECT {by}, price, count(*) AS n, min(ord) AS f FROM s WHERE price <> '' GROUP BY ALL),
    pm AS (SELECT {by}, sum(n) AS priced, max(n) AS mode_count FROM m GROUP BY ALL),
    c AS (SELECT {by}, count(*) AS products, count(*) FILTER (product_name <> '') AS name, count(*) FILTER (price <> '') AS price, count(*) FILTER (sku <> '') AS sku, count(*) FILTER (upc <> '' OR ean <> '' OR gtin <> '' OR gtin_case <> '') AS barcode,
        count(*) FILTER (product_url <> '') AS product_url, count(*) FILTER (image_url <> '') AS image_url FROM s GROUP BY ALL),
    w AS (SELECT c.*, CASE WHEN products < 3 THEN 0.2 ELSE 0 END + CASE WHEN name / products < 0.7 THEN 0.2 ELSE 0 END + CASE WHEN product_url / products < 0.3 THEN 0.2 ELSE 0 END
        + CASE WHEN price = 0 AND sku = 0 AND barcode = 0 THEN 0.35 ELSE 0 END + CASE WHEN barcode / products < 0.2 THEN 0.15 ELSE 0 END + CASE WHEN priced >= 6 AND mode_count / priced > 0.8 THEN 0.2 ELSE 0 END AS lost,
        CAST(products < 3 AS INT) + CAST(name / products < 0.7 AS INT) + CAST(product_url / products < 0.3 AS INT) + CAST(price = 0 AND sku = 0 AND barcode = 0 AS INT) + CAST(barcode / products < 0.2 AS INT) + CAST(coalesce(priced >= 6 AND mode_count / priced > 0.8, false) AS INT) AS warnings
        FROM c LEFT JOIN pm USING ({by}))
    SELECT {by}, products, name, price, sku, barcode, product_url, image_url, CAST(warnings AS INT) AS n_warnings, CAST(round_even(greatest(0, 1 - CAST(lost AS DOUBLE)), 2) AS DOUBLE) AS score FROM w"""


@query("q_quality_by_category", s_quality(C, "category"))
def quality_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(rows(spark, sf_dir, "catalog"), ["category"])
    return report.withColumn("n_warnings", F.size("warnings")).drop("warnings")


@query("q_quality_by_price", s_quality(f"(SELECT *, price AS price_group FROM {C} c)", "price_group"))
def quality_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one price each: every group of six rows or more has a price anomaly."""
    report = quality.quality_report(rows(spark, sf_dir, "catalog").withColumn("price_group", F.col("price")), ["price_group"])
    return report.withColumn("n_warnings", F.size("warnings")).drop("warnings")


@query(
    "q_coverage",
    f"SELECT brand, {', '.join(f'round_even(count(*) FILTER (trim({c}) <> {chr(39) * 2}) / count(*), 3) AS {c}_coverage' for c in ('product_name', 'price', 'sku'))}, round_even(count(*) FILTER (upc <> '' OR ean <> '' OR gtin <> '' OR gtin_case <> '') / count(*), 3) AS barcode_coverage FROM {C} c GROUP BY 1",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(rows(spark, sf_dir, "catalog"), ["brand"], ["product_name", "price", "sku"])


@query(
    "q_price_mode",
    f"""WITH m AS (SELECT run, price, count(*) AS n, min(ord) AS f FROM {FEED} x WHERE price <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY run) AS priced FROM m)
    SELECT run, CAST(priced AS BIGINT) AS priced, price AS mode_price, n AS mode_count FROM r WHERE rn = 1""",
)
def price_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.price_modes(rows(spark, sf_dir, "feed"), ["run"])


@query(
    "q_run_summary",
    f"""WITH f AS (SELECT *, concat(brand, '; ', CASE WHEN ord % 2 = 0 THEN 'even; ' ELSE '' END, 'all') AS category FROM {FEED} x), c AS (SELECT run, count(DISTINCT k) AS categories FROM (SELECT run, unnest(string_split(category, '; ')) AS k FROM f) WHERE k <> '' GROUP BY 1),
    b AS (SELECT run, count(*) AS rows, count(*) FILTER (upc <> '') AS with_identifier, count(*) FILTER (sku <> '') AS with_sku, count(DISTINCT nullif(brand, '')) AS brands FROM f GROUP BY 1) SELECT * FROM b JOIN c USING (run)""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows(spark, sf_dir, "feed").withColumn("category", F.concat("brand", F.lit("; "), F.when(F.col("ord") % 2 == 0, "even; ").otherwise(""), F.lit("all")))
    return quality.run_summary(f, ["run"])


@query(
    "q_brand_category_rollup",
    f"SELECT brand, category, CAST(grouping(brand) * 2 + grouping(category) AS BIGINT) AS level, count(*) AS n, count(DISTINCT price) AS prices FROM {C} c GROUP BY ROLLUP (brand, category)",
)
def brand_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "catalog").rollup("brand", "category").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.countDistinct("price").alias("prices"))


@query(
    "q_brand_category_cube",
    f"SELECT brand, category, CAST(grouping(brand) * 2 + grouping(category) AS BIGINT) AS level, count(*) AS n FROM {C} c GROUP BY CUBE (brand, category)",
)
def brand_category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "catalog").cube("brand", "category").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query(
    "q_recovery_needed",
    f"""WITH r AS (SELECT run, count(*) AS rows, count(*) FILTER (upc <> '') AS barcodes FROM {FEED} f GROUP BY 1) SELECT run, rows, barcodes, barcodes / rows AS barcode_share, rows < 3000 * 0.9 OR barcodes / rows < 0.75 AS recover FROM r""",
)
def recovery_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recovery_needed(rows(spark, sf_dir, "feed"), ["run"], F.lit(3000))


@query(
    "q_strongest_result",
    f"""WITH r AS (SELECT run, brand, count(*) AS rows, count(*) FILTER (upc <> '') AS barcodes, min(ord) AS ord FROM {FEED} f GROUP BY 1, 2)
    SELECT run, brand, rows, barcodes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rows DESC, barcodes DESC, barcodes / rows DESC, ord) AS rn FROM r) WHERE rn = 1""",
)
def strongest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir, "feed").groupBy("run", "brand").agg(F.count("*").alias("rows"), F.count_if(F.col("upc") != "").alias("barcodes"), F.min("ord").alias("ord")).withColumn("barcode_share", F.col("barcodes") / F.col("rows"))
    return quality.strongest(r, ["run"]).select("run", "brand", "rows", "barcodes")


# --- errors and benchmark ------------------------------------------------------------------------------------------
ERRORS = """CASE event_id % 8 WHEN 0 THEN 'Read timed out. (read timeout=20)' WHEN 1 THEN '403 Client Error: Forbidden' WHEN 2 THEN 'getaddrinfo failed' WHEN 3 THEN '500 Server Error' WHEN 4 THEN 'list index out of range' WHEN 5 THEN 'robot check' WHEN 6 THEN 'SSL handshake' ELSE '' END"""


def s_error(e: str) -> str:
    any_of = lambda ws: " OR ".join(f"contains(lower({e}), '{w}')" for w in ws)
    return f"(CASE {' '.join(f'WHEN {any_of(ws)} THEN {chr(39)}{k}{chr(39)}' for k, ws in scoring.ERROR_WORDS.items())} WHEN regexp_matches({e}, '\\b(4[0-9][0-9]|5[0-9][0-9])\\b') THEN 'http_error' ELSE 'runtime_error' END)"


@query("q_error_classify", f"SELECT {s_error('e')} AS category, CAST(count(*) AS BIGINT) AS n FROM (SELECT {ERRORS} AS e FROM events) GROUP BY 1")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.load(spark, sf_dir, "events").selectExpr(f"{ERRORS} AS e")
    return e.groupBy(scoring.error_category(F.col("e")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "q_error_report",
    f"SELECT event_id, {s_error('e')} AS error_category, CASE WHEN trim(e) = '' THEN 'Unknown error.' ELSE substr(trim(e), 1, 500) END AS error_message, CASE {' '.join(f'WHEN {s_error("e")} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in scoring.ERROR_WARNINGS.items())} END AS warning FROM (SELECT event_id, {ERRORS} AS e FROM events)",
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.load(spark, sf_dir, "events").selectExpr("event_id", f"{ERRORS} AS e").withColumn("r", scoring.error_report(F.col("e")))
    return e.select("event_id", "r.error_category", "r.error_message", F.col("r.warnings")[0].alias("warning"))


RESULTS = f"SELECT event_id, event_type AS segment, {ERRORS} AS e, cast(event_id % 6 AS bigint) AS n_rows, cast(event_id % 11 AS double) / 10 AS name_coverage, cast(event_id % 21 AS double) / 20 AS quality_score, value AS elapsed_seconds FROM events"
_STATUS = f"CASE WHEN e <> '' AND {s_error('e')} IN ('timeout', 'blocked') THEN {s_error('e')} WHEN e <> '' THEN 'error' WHEN n_rows = 0 THEN 'fail' WHEN n_rows >= 3 AND name_coverage >= 0.7 AND quality_score >= 0.65 THEN 'pass' ELSE 'partial' END"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = RESULTS.removeprefix("SELECT ").removesuffix(" FROM events")
    head, tail = part.split(ERRORS)
    names = [x.strip() for x in head.strip().rstrip(",").split(",")] + [f"{ERRORS} AS e"] + ["cast(event_id % 6 AS bigint) AS n_rows", "cast(event_id % 11 AS double) / 10 AS name_coverage", "cast(event_id % 21 AS double) / 20 AS quality_score", "value AS elapsed_seconds"]
    r = base.load(spark, sf_dir, "events").selectExpr(*names)
    return r.withColumn("status", scoring.benchmark_status(F.col("e"), F.col("n_rows"), F.col("name_coverage"), F.col("quality_score")))


@query("q_benchmark_status", f"SELECT event_id, {_STATUS} AS status FROM ({RESULTS})")
def benchmark_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("event_id", "status")


@query(
    "q_benchmark_summary",
    f"""SELECT segment, count(*) AS total, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS "{s}"' for s in quality.STATUSES)}, round_even(avg(quality_score), 3) AS avg_quality_score, round_even(avg(elapsed_seconds), 2) AS avg_elapsed_seconds,
        round_even(count(*) FILTER (status = 'pass') / count(*), 3) AS pass_rate FROM (SELECT *, {_STATUS} AS status FROM ({RESULTS})) GROUP BY 1""",
)
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.benchmark_summary(_results(spark, sf_dir), ["segment"])


# --- merges --------------------------------------------------------------------------------------------------------
_D1 = f"(SELECT product_url, {', '.join(f'min_by({c}, ord) AS {c}' for c in ('product_name', 'brand', 'sku', 'upc', 'price'))} FROM {DETAIL} d GROUP BY 1)"


def s_merge(rules: dict[str, str], more: str = "") -> str:
    pick = {"d": "coalesce(nullif(d.{c}, ''), nullif(c.{c}, ''), '')", "c": "coalesce(nullif(c.{c}, ''), nullif(d.{c}, ''), '')"}
    return f"SELECT c.ord, c.product_url, {', '.join(pick[r].format(c=c) + ' AS ' + c for c, r in rules.items())}{more} FROM {C} c LEFT JOIN {_D1} d ON d.product_url = c.product_url"


_MERGE_COLS = ["product_name", "brand", "sku", "upc", "price"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rows(spark, sf_dir, "catalog").select("ord", "product_url", *_MERGE_COLS), rows(spark, sf_dir, "detail")


@query("q_detail_enrich", s_merge(dict.fromkeys(_MERGE_COLS, "d")))
def detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.enrich_detail_wins(*_sides(spark, sf_dir))


@query("q_backfill", s_merge(dict.fromkeys(_MERGE_COLS, "c"), ", CASE WHEN c.upc = '' AND coalesce(d.upc, '') <> '' THEN 'detail_upc' ELSE '' END AS upc_source"))
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.backfill_listing_wins(*_sides(spark, sf_dir))


@query("q_llm_merge", s_merge({"product_name": "c", "brand": "c", "sku": "c", "upc": "d", "price": "c"}))
def llm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_from_model(*_sides(spark, sf_dir))


@query("q_anti_append", f"SELECT ord, product_url, product_name FROM {C} c UNION ALL SELECT ord, product_url, product_name FROM {DETAIL} d WHERE product_url NOT IN (SELECT product_url FROM {C} c)")
def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: rows(spark, sf_dir, k).select("ord", "product_url", "product_name")
    return merge.append_missing(pick("catalog"), pick("detail"), "product_url")


@query("q_links_to_enrich", f"SELECT DISTINCT d.product_url FROM {DETAIL} d WHERE product_url IN (SELECT product_url FROM {C} c)")
def links_to_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.links_to_enrich(rows(spark, sf_dir, "detail").select("product_url"), rows(spark, sf_dir, "catalog").select("product_url"))


def s_match_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({c}, '[a-z0-9]+'), lambda x: length(x) >= 3))"


def s_fold(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


@query(
    "q_best_detail",
    f"""WITH p AS (SELECT c.ord, d.ord AS dord, (CASE WHEN {s_fold('c.sku')} <> '' AND {s_fold('d.sku')} <> '' AND (contains({s_fold('c.sku')}, {s_fold('d.sku')}) OR contains({s_fold('d.sku')}, {s_fold('c.sku')})) THEN 80 ELSE 0 END
        + CASE WHEN c.product_url <> '' AND rtrim(c.product_url, '/') = rtrim(d.product_url, '/') THEN 60 ELSE 0 END + least(30, 5 * len(list_intersect({s_match_tokens('c.product_name')}, {s_match_tokens('d.product_name')}))) + CASE WHEN d.upc <> '' THEN 10 ELSE 0 END) AS score
        FROM {C} c JOIN {DETAIL} d ON c.ord // 40 = d.ord // 40)
    SELECT ord, dord AS detail_ord, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, dord) AS rn FROM p) WHERE rn = 1""",
)
def best_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = lambda k: rows(spark, sf_dir, k).withColumn("page", F.floor(F.col("ord") / 40))
    return merge.best_detail(paged("catalog"), paged("detail"), "page").select("ord", "detail_ord", F.col("score").cast("int").alias("score"))


# --- ranking, routing, scoring -------------------------------------------------------------------------------------
_STRENGTH = "CAST((CASE WHEN trim(brand) <> '' THEN 3 ELSE 0 END + CASE WHEN trim(coalesce(nullif(unit_size, ''), pack_size)) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(case_pack) <> '' THEN 1 ELSE 0 END + CASE WHEN length(trim(product_name)) >= 12 THEN 2 ELSE 0 END + CASE WHEN trim(sku) <> '' THEN 1 ELSE 0 END) AS INT)"


def _columns(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


@query("q_row_strength", f"SELECT ord, {_STRENGTH} AS strength FROM {C} c")
def row_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "catalog")
    return df.select("ord", scoring.row_strength(_columns(df)).cast("int").alias("strength"))


_CANDY = " OR ".join(f"contains(lower(product_name), '{w}')" for w in scoring.CANDY_WORDS)
_GROUP = f"""CASE WHEN length(trim(product_name)) < 8 AND NOT (trim(product_name) <> '' AND (brand <> '' OR sku <> '')) AND {_STRENGTH} < 3 THEN 'too_weak_to_query' WHEN ({_CANDY}) AND brand <> '' AND unit_size <> '' THEN 'consumer_candy_strong' WHEN {_CANDY} THEN 'consumer_candy_weak'
    WHEN brand <> '' AND (unit_size <> '' OR pack_size <> '') THEN 'strong_identity' WHEN brand <> '' OR sku <> '' THEN 'partial_identity' ELSE 'weak_identity' END"""
_ROUTES = values([(g, p, i) for g, ps in scoring.ROUTES.items() for i, p in enumerate(ps)], ["row_group", "provider", "position"])


@query("q_provider_route", f"SELECT ord, g AS row_group, provider, CAST(position AS INT) AS position FROM (SELECT ord, {_GROUP} AS g FROM {C} c) JOIN (SELECT * FROM {_ROUTES}) r ON r.row_group = g")
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "catalog")
    routes = spark.createDataFrame([(g, p, i) for g, ps in scoring.ROUTES.items() for i, p in enumerate(ps)], "row_group string, provider string, position int")
    return df.select("ord", scoring.row_group(_columns(df)).alias("row_group")).join(F.broadcast(routes), "row_group").select("ord", "row_group", "provider", "position")  # a fixed table of some rows


@query(
    "q_budget",
    f"""WITH s AS (SELECT ord, category, {_STRENGTH} AS strength, CAST({s_barcode('upc')} = '' AS INT) AS need FROM {C} c), u AS (SELECT *, sum(need) OVER (PARTITION BY category ORDER BY strength DESC, ord ROWS UNBOUNDED PRECEDING) AS used FROM s)
    SELECT ord, CASE WHEN need = 0 THEN 'not_needed' WHEN used <= 20 THEN 'looked_up' ELSE 'external_lookup_skipped_budget' END AS lookup_status FROM u""",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "catalog")
    return merge.within_budget(df, scoring.row_strength(_columns(df)), ids.barcode(F.col("upc")) == "", 20, ["category"]).select("ord", "lookup_status")


#: Candidates for every product, as a search for a group of 40 products gives them; titles share some words.
CANDIDATES = {"cand": "p_partkey", "title": "concat(p_name, ' ', cast(p_size AS string), ' OZ')", "c_brand": "CASE WHEN p_partkey % 4 = 0 THEN 'Other' ELSE p_brand END", "c_pack": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(cast(p_size AS string), ' OZ') END", "c_size": "p_size", "c_key": "cast(floor(p_partkey / 40) AS bigint)"}
_CANDS = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in CANDIDATES.items())} FROM part)"
_PS = "CASE WHEN unit_size <> '' THEN unit_size WHEN pack_size <> '' THEN pack_size ELSE '' END"
_SCORE = f"""(CASE WHEN {s_key('brand')} = '' THEN 0 WHEN {s_key('brand')} = {s_key('c_brand')} THEN 30 WHEN contains({s_key('brand')}, {s_key('c_brand')}) OR contains({s_key('c_brand')}, {s_key('brand')}) THEN 18 ELSE -35 END
    + 19 + CASE WHEN shared >= 4 THEN 8 WHEN shared >= 2 THEN 4 ELSE 0 END + CASE WHEN {_PS} = '' THEN 0 WHEN {_PS} = concat(CAST(c_size AS VARCHAR), ' OZ') THEN 22 ELSE -18 END + CASE WHEN case_pack = '' THEN 0 ELSE -4 END
    + CASE WHEN sku <> '' AND contains({s_key('title')}, {s_key('sku')}) THEN 8 ELSE 0 END - CASE WHEN shared = 0 THEN 20 ELSE 0 END)"""
_SCORED = f"SELECT ord, cand, CAST(greatest(0, least(100, {_SCORE})) AS INT) AS score FROM (SELECT c.*, k.*, len(list_intersect({s_tokens('product_name')}, {s_tokens('title')})) AS shared FROM {C} c JOIN {_CANDS} k ON c.ord // 40 = k.c_key)"


def _scored(spark: SparkSession, sf_dir: str, fuzzy: bool) -> DataFrame:
    cands = base.load(spark, sf_dir, "part").selectExpr(*(f"{e} AS {c}" for c, e in CANDIDATES.items()))
    cands = cands.select("c_key", "cand", scoring.candidate_features({"title": F.col("title"), "brand": F.col("c_brand"), "pack_size": F.col("c_pack")}).alias("c"))
    products = rows(spark, sf_dir, "catalog")
    products = products.select("ord", F.floor(F.col("ord") / 40).alias("c_key"), scoring.product_features(_columns(products)).alias("p"))
    return products.join(cands, "c_key").select("ord", "cand", scoring.feature_score(F.col("p"), F.col("c"), fuzzy).cast("int").alias("score"))


@query("q_candidate_score_nofuzzy", _SCORED)
def candidate_score_nofuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False)


@query("q_candidate_score")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the sequence matcher's ratio, which SQL lacks; the tests check it row by row."""
    df = _scored(spark, sf_dir, True)
    return df.withColumns({"confidence": scoring.confidence(F.col("score")), "color": scoring.confidence_color(F.col("score"))})


@query("q_topk_candidates", f"SELECT ord, cand, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, cand) AS rank FROM ({_SCORED}) WHERE score >= 45) WHERE rank <= 6")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.top_k(_scored(spark, sf_dir, False).where("score >= 45"), ["ord"], [F.desc("score"), F.asc("cand")], 6)


@query(
    "q_until_good_enough",
    f"""WITH s AS (SELECT ord, cand % 5 AS position, max(score) AS score FROM ({_SCORED}) GROUP BY 1, 2), b AS (SELECT *, max(score) OVER (PARTITION BY ord ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    t AS (SELECT * FROM b WHERE before IS NULL OR before < 60) SELECT ord, max(score) AS score, CAST(arg_max(position, score * 100 - position) AS BIGINT) AS position, count(*) AS queries_tried FROM t GROUP BY ord""",
)
def until_good_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir, False).withColumn("position", F.col("cand") % 5)
    return merge.until_good_enough(s, "ord", "position", "score", 60)


_J = lambda *xs: f"concat_ws(' ', {', '.join(xs)})"
_QS = [("b <> '' AND n <> '' AND p <> ''", _J("b", "n", "p")), ("b <> '' AND n <> '' AND c <> ''", _J("b", "n", "'case'", "c")), ("b <> '' AND n <> ''", _J("b", "n")), ("n <> '' AND p <> ''", _J("n", "p")), ("n <> '' AND c <> ''", _J("n", "'case'", "c")), ("b <> '' AND s <> '' AND n <> ''", _J("b", "s", "n")), ("n <> ''", "n"), ("b <> '' AND s <> ''", _J("b", "s"))]


@query(
    "q_build_queries",
    f"SELECT ord, CAST(i AS INT) AS position, x.q AS query FROM (SELECT ord, unnest(list_zip(range(0, 8), list_filter([{', '.join(f'CASE WHEN {c} THEN {q} END' for c, q in _QS)}], lambda v: v IS NOT NULL))) AS z FROM (SELECT ord, trim(brand) AS b, trim(product_name) AS n, trim(pack_size) AS p, trim(case_pack) AS c, trim(sku) AS s FROM {C} c)), LATERAL (SELECT z[1] AS i, z[2] AS q) x WHERE x.q IS NOT NULL",
)
def build_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text.lookup_queries(*(F.col(c) for c in ("brand", "product_name", "pack_size", "case_pack", "sku")))
    return rows(spark, sf_dir, "catalog").select("ord", F.posexplode(q).alias("position", "query"))


@query("q_query_key", f"SELECT ord, sha256(concat('upcitemdb::', product_name)) AS cache_key FROM {C} c")
def query_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "catalog").select("ord", F.sha2(F.concat(F.lit("upcitemdb::"), "product_name"), 256).alias("cache_key"))


# --- text and URLs -------------------------------------------------------------------------------------------------
@query(
    "q_strip_html",
    r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages",
)
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.load(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html"), entities=False).alias("plain"))


@query(
    "q_word_keys",
    f"SELECT ord, {s_key('product_name')} AS word_key, trim(regexp_replace(lower(product_name), '[^a-z0-9 ]', '', 'g')) AS name_key, CAST(len({s_tokens('product_name')}) AS INT) AS n_tokens FROM {C} c",
)
def word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("product_name")
    return rows(spark, sf_dir, "catalog").select("ord", text.word_key(n).alias("word_key"), text.name_key(n).alias("name_key"), F.size(text.tokens(n)).alias("n_tokens"))


@query(
    "q_url_parts",
    r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') = 'site0.example' AS on_site0 FROM pages",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return base.load(spark, sf_dir, "pages").select("page_id", url.scheme(u).alias("scheme"), url.netloc(u).alias("host"), url.path(u).alias("path"), url.same_site(F.lit("https://www.site0.example/"), u).alias("on_site0"))


_URLS = [(1, "https://a.example/product/blue-syrup"), (2, "https://a.example/collections/all"), (3, "https://a.example/x/y.html"), (4, "https://a.example/syrup.html"), (5, "https://a.example/heavy-duty-bottle-24152"), (6, "https://a.example/p/1.jpg"), (7, ""), (8, "https://a.example/short-1"), (9, "https://a.example/item/9?page=2")]
_URL_TRUTH = {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False, 9: True}


@query("q_product_urls", f"SELECT CAST(i AS BIGINT) AS id, u AS url, ok AS is_product FROM {values([(i, u, str(_URL_TRUTH[i]).lower()) for i, u in _URLS], ['i', 'u', 'o'])}, LATERAL (SELECT o = 'true' AS ok)")
def product_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_URLS, "id long, url string").withColumn("is_product", url.is_product_url(F.col("url")))


@query("q_url_keys", r"SELECT ord, regexp_replace(product_url, '/+$', '') AS url_key, CASE WHEN product_url = '' THEN '' ELSE regexp_extract(regexp_replace(product_url, '/+$', ''), '([^/]*)$', 1) END AS name FROM " + C + " c")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("product_url")
    return rows(spark, sf_dir, "catalog").select("ord", url.url_key(u).alias("url_key"), url.name_from_url(u).alias("name"))


@query("q_page_urls", "SELECT ord, concat('https://shop.example/list?q=x&page=', CAST(target AS VARCHAR)) AS first_url, CAST(1 AS INT) AS n FROM (SELECT p_partkey AS ord, p_size AS target FROM part)")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = url.page_urls(F.lit("https://shop.example/list?q=x&page=1"), F.col("p_size"), F.lit(None).cast("int"))
    return base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), urls.alias("u")).select("ord", F.col("u")[0].alias("first_url"), F.size("u").alias("n"))


@query("q_pagination", "SELECT p_partkey AS ord, CAST(p_partkey AS INT) AS total_products, CAST(10 AS INT) AS per_page, CAST(ceil(p_partkey / 10) AS INT) AS total_pages FROM part WHERE p_partkey > 0 UNION ALL SELECT 0, NULL, NULL, NULL FROM part WHERE p_partkey = 0")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Items 1-10 of "), F.format_number(F.col("p_partkey"), 0), F.lit(" in stock"))
    df = base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), url.pagination(said).alias("p"))
    return df.select("ord", "p.total_products", "p.per_page", "p.total_pages")


@query(
    "q_catalog_links",
    f"""SELECT ord, CAST(CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in scoring.OTHER_WORDS)} THEN -10 ELSE {' + '.join(f"CASE WHEN contains(t, '{w}') THEN 2 ELSE 0 END" for w in scoring.CATALOG_WORDS)}
        + CASE WHEN regexp_matches(t, '/(c|cat|category|categories|collections|shop|products?)(/|$)') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'all products') OR contains(t, 'shop all') THEN 6 ELSE 0 END END AS INT) AS score
    FROM (SELECT p_partkey AS ord, lower(concat(p_type, ' ', CASE p_partkey % 4 WHEN 0 THEN '/collections/new' WHEN 1 THEN '/login' WHEN 2 THEN '/shop' ELSE '/x' END)) AS t FROM part)""",
)
def catalog_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    href = F.concat(F.lit("https://a.example"), F.when(k == 0, "/collections/new").when(k == 1, "/login").when(k == 2, "/shop").otherwise("/x"))
    return base.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), scoring.catalog_link_score(F.col("p_type"), href).cast("int").alias("score"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
