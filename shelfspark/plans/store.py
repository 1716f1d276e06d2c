"""Queries of run bookkeeping, over runs derived from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs as store
from .base import load
from .queries import ERRORS, query

RUN = {
    "id": "event_id",
    "label": "event_type",
    "source_url": "concat('https://shop.example/', cast(user_id AS string))",
    "strategy_name": "''",
    "product_count": "cast(0 AS bigint)",
    "status": "CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'completed' ELSE 'failed' END",
    "error_message": "''",
    "started_at": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END",
    "timestamp": "ts",
}
_RUNS = f"(SELECT {', '.join(f'{e} AS {chr(34)}{c}{chr(34)}' for c, e in RUN.items())} FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*(f"{e} AS `{c}`" for c, e in RUN.items())).withColumn("diagnostics", F.lit(None).cast("string"))


_NOW = "(SELECT max(ts) FROM events)"


@query("q_stale_runs", f"""SELECT id, CASE WHEN status = 'running' AND coalesce(started_at, "timestamp") < {_NOW} - INTERVAL 6 HOURS THEN 'failed' ELSE status END AS status FROM {_RUNS} r""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    now = load(spark, sf_dir, "events").agg(F.max("ts").alias("_now"))  # one row
    return store.sweep_stale(runs.join(F.broadcast(now)), F.col("_now")).select("id", "status")


@query("q_run_history", f'SELECT id, label, source_url, status FROM {_RUNS} r')
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history(_runs(spark, sf_dir)).select("id", "label", "source_url", "status")


@query("q_complete_runs", f"SELECT id, CASE WHEN id % 6 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN id * 2 ELSE 0 END AS product_count, CASE WHEN id % 6 = 0 THEN 'feed' ELSE '' END AS strategy_name FROM {_RUNS} r")
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    results = runs.where("id % 6 = 0").select("id", F.lit("feed").alias("strategy_name"), (F.col("id") * 2).alias("product_count"), F.lit("{}").alias("diagnostics"))
    return store.complete(runs, results).select("id", "status", "product_count", "strategy_name")


@query("q_fail_runs", f"SELECT e.event_id AS id, CASE WHEN m <> '' THEN 'failed' ELSE status END AS status, substr(m, 1, 500) AS error_message FROM (SELECT event_id, {ERRORS} AS m FROM events) e JOIN {_RUNS} r ON r.id = e.event_id")
def fail_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = load(spark, sf_dir, "events").selectExpr("event_id AS id", f"{ERRORS} AS error").where("error <> ''")
    return store.fail(_runs(spark, sf_dir), errors).select("id", "status", "error_message")


@query("q_delete_runs", f"SELECT 'run' AS kind, id, 1 AS n FROM {_RUNS} r WHERE id % 10 <> 0 UNION ALL SELECT 'item', user_id, count(*) FROM events WHERE user_id % 10 <> 0 OR user_id NOT IN (SELECT event_id FROM events WHERE event_id % 10 = 0) GROUP BY 2")
def delete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    items = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"))
    left, rest = store.delete(runs, items, runs.where("id % 10 = 0").select("id"))
    return left.select(F.lit("run").alias("kind"), "id", F.lit(1).cast("long").alias("n")).unionByName(rest.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("item")))


@query("q_rename_runs", f"SELECT id, CASE WHEN id % 4 = 0 THEN concat('run ', id) ELSE label END AS label FROM {_RUNS} r")
def rename_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return store.rename(runs, runs.where("id % 4 = 0").selectExpr("id", "concat('  run ', id, ' ') AS label")).select("id", "label")


@query("q_run_lookup", f"SELECT r.id, r.status, (SELECT string_agg(concat(event_type, i.event_id), ' ' ORDER BY i.event_id) FROM events i WHERE i.user_id = r.id) AS items FROM {_RUNS} r WHERE r.id % 5 = 0")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    items = load(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_id AS ord", "concat(event_type, event_id) AS product_name")
    found = store.lookup(runs, items, runs.where("id % 5 = 0").select("id"))
    return found.select("id", "status", F.array_join(F.transform("items", lambda x: x["product_name"]), " ").alias("items"))


@query("q_run_diagnostics", f"SELECT id, CASE WHEN id % 3 = 0 THEN id % 7 END AS pages, CASE WHEN id % 3 = 0 THEN 'done' END AS reason FROM {_RUNS} r")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE id % 3 WHEN 0 THEN concat('{\"pages\":', id % 7, ',\"stop\":{\"reason\":\"done\"}}') WHEN 1 THEN 'no json' END"
    runs = _runs(spark, sf_dir).withColumn("diagnostics", F.expr(text))
    return store.decoded(runs, "pages long, stop struct<reason:string>").select("id", "diagnostics.pages", "diagnostics.stop.reason")


@query("q_migrate_runs", f"SELECT id, label, CASE WHEN id % 2 = 0 THEN '' ELSE status END AS status FROM {_RUNS} r")
def migrate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return store.migrate(runs.where("id % 2 = 0").select("id", "label"), runs.where("id % 2 = 1").select("id", "label", "status"))


@query("q_cookie_scope", "SELECT event_id AS id, event_id % 4 IN (0, 1) AS in_scope FROM events")
def cookie_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").selectExpr("event_id AS id", "element_at(array('.Shop.example', 'b.shop.example', 'op.example', ''), cast(event_id % 4 + 1 AS int)) AS domain")
    kept = store.in_scope(e, F.lit("a.b.shop.example")).select("id", F.lit(True).alias("ok"))
    return e.join(kept, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("in_scope"))


@query("q_choose_targets", "SELECT event_id AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id % 3 = 1")
def choose_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    wanted = e.agg(F.min("event_type")).first()[0]
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit(" "), F.initcap("event_type")).alias("segment"), F.concat(F.lit("L"), F.col("event_id") % 3).alias("label"))
    return store.choose_targets(rows, [wanted.upper()], ["l1 "]).select("id")


@query("q_provider_cooldown", f"SELECT DISTINCT event_type AS provider FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE ts + INTERVAL 300 SECONDS > {_NOW})")
def provider_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("_now"))  # one row
    state = e.select(F.col("event_type").alias("provider"), (F.col("ts") + F.expr("INTERVAL 300 SECONDS")).alias("until")).join(F.broadcast(now))
    return store.available(e.select(F.col("event_type").alias("provider")).distinct(), state, F.col("_now"))


@query("q_query_cache", "SELECT p_partkey AS ord, p_partkey % 3 = 0 AS kept, CASE WHEN p_partkey % 3 = 0 THEN concat('{\"n\":', p_partkey, '}') END AS payload FROM part")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "part").select(F.lit("go_upc").alias("provider"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("query"), F.col("p_partkey").alias("ord"))
    cache = asked.where("ord % 3 = 0").select(store.query_key(F.col("provider"), F.col("query")).alias("key"), F.concat(F.lit('{"n":'), "ord", F.lit("}")).alias("payload"))
    hits, misses = store.from_cache(asked, cache)
    return hits.select("ord", F.lit(True).alias("kept"), "payload").unionByName(misses.select("ord", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("payload")))


@query("q_event_windows", "SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, CAST(round(sum(value), 3) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.plans import event_windows as plan

    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return plan(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("q_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.plans import sessions as plan

    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return plan(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(load(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parq*t")


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there, written to the shared folder and read back."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("a stream writes to the folder that spark.checkpoint.dir names")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("q_stream_new_pages", r"SELECT site, count(*) AS n FROM (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS site, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM pages) GROUP BY 1")
def stream_new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are seen at one moment: each site's contents come once."""
    from ..streaming.plans import new_pages

    pages = _stream(spark, sf_dir, "pages").withColumn("seen_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return _drained(new_pages(pages).select("site", "fingerprint"), "new-pages").groupBy("site").agg(F.count("*").alias("n"))


@query("q_stream_first_urls", "SELECT product_url FROM (SELECT DISTINCT concat('u', user_id) AS product_url FROM events)")
def stream_first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.plans import first_by_url

    rows = _stream(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("product_url"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("seen_at"))
    return _drained(first_by_url(rows), "first-urls").select("product_url")


@query("q_stream_budget", "SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 > 0 THEN 'not_needed' WHEN row_number() OVER (PARTITION BY p_brand, p_partkey % 5 = 0 ORDER BY p_size DESC, p_partkey) <= 7 THEN 'looked_up' ELSE 'external_lookup_skipped_budget' END AS lookup_status FROM part")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.plans import budgeted

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("a stream writes to the folder that spark.checkpoint.dir names")
    path = f"{base.rstrip('/')}/budget-{uuid.uuid4().hex}"
    rows = _stream(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "p_brand AS run", "p_size AS strength", "p_partkey % 5 = 0 AS needs_lookup")
    budgeted(rows, f"{path}/out", 7).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("ord", "lookup_status")
