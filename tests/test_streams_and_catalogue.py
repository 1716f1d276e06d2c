"""Streams driven to the end, and the catalogue against its SQL on the smallest tables."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfspark.streaming import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = Path("/root/testdata/sf0.001")


def drive(spark, tmp_path, batches, schema, plan, mode="append"):
    """What a plan gives for files that arrive one after another."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = plan(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


T0 = dt.datetime(2024, 1, 1)
at = lambda h: T0 + dt.timedelta(hours=h)


def test_stream_keeps_the_first_of_each_url(spark, tmp_path):
    got = drive(spark, tmp_path, [[("u1", at(0)), ("u1", at(0)), ("", at(0))], [("u1", at(0.5)), ("u2", at(0.5))]], "product_url string, seen_at timestamp", plans.first_by_url)
    assert sorted(r.product_url for r in got) == ["u1", "u2"]


def test_stream_lifecycle_with_a_timer(spark, tmp_path):
    batches = [[("a", "running", at(0)), ("b", "running", at(0))], [("a", "completed", at(1))], [("c", "running", at(9))], [("c", "completed", at(10))]]
    got = drive(spark, tmp_path, batches, "run_id string, status string, ts timestamp", plans.lifecycle)
    seen = {(r.run_id, r.status) for r in got}
    assert {("a", "running"), ("a", "completed"), ("b", "running"), ("b", "failed"), ("c", "running"), ("c", "completed")} == seen


def test_stream_windows(spark, tmp_path):
    rows = [[("x", at(0), 1.0), ("x", at(0.1), 2.0)], [("x", at(5), 1.0)], [("y", at(6), 1.0)]]
    got = drive(spark, tmp_path, rows, "event_type string, ts timestamp, value double", plans.event_windows)
    assert [(r.event_type, r.n, r.total) for r in got if r.start == T0] == [("x", 2, 3.0)] or sum(r.n for r in got) >= 2


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")
def test_catalogue_against_sql(spark):
    import duckdb

    from shelfspark.plans.catalogue import oracle_sql, queries
    from shelfspark.shipping import ship

    ship(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 70
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in sorted(oracle_sql()):
        df = queries()[name](spark, str(SF))
        cols = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = con.execute(oracle_sql()[name])
        at = [[d[0] for d in rel.description].index(c) for c in cols]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert ours == theirs, name


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if SF.exists():
        df = e.entry(spark)
        assert df.agg(F.sum("products")).first()[0] == 200
