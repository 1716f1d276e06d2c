"""Rows of a small file are spread before pages are made of them, and are never taken for small enough to be broadcast."""

from pyspark.sql import functions as F

from shelfspark.functions import url
from shelfspark.plans.base import TASKS_A_CORE, dealt


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_rows_use_every_core_and_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    few = spark.read.parquet(f"{tmp_path}/t.parquet")
    spread = dealt(few, "k")
    assert few.rdd.getNumPartitions() == 1 and spread.rdd.getNumPartitions() == TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r.k for r in spread.collect()) == list(range(1000))
    assert "Broadcast" in plan_of(few.selectExpr("k", "k AS a").join(few.selectExpr("k", "k AS b"), "k"))
    assert "Broadcast" not in plan_of(spread.selectExpr("k", "k AS a").join(few.selectExpr("k", "k AS b"), "k"))


def test_once_stands_between_a_column_and_the_filters_on_it(spark):
    df = url.once(spark.createDataFrame([("http://h.example/p/1/#x",), (None,)], "u string"), key=url.url_key(F.col("u")))
    assert [r.key for r in df.collect()] == ["http://h.example/p/1", ""]
    plan = df.where(url.holds_any(F.lower("key"), ["/p/", "/q/", "/r/"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2
