"""Memory between the pipeline's stages and in gathering ids."""

import tracemalloc

import numpy as np

import corpus_pipeline
from shelfspark.llm.tokens import gathered


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return {b.getName(): b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep", "Shenandoah", "ZGC"))}


def test_a_stage_begins_on_small_heaps(spark):
    before = collections(spark)
    corpus_pipeline.stage(lambda s, docs, d: docs)(spark, spark.range(1), "")
    assert before and sum(collections(spark).values()) > sum(before.values())


def test_gathering_holds_two_small_indexes():
    flat = np.arange(1 << 20, dtype=np.uint32)
    start, size = np.arange(0, 1 << 20, 4), np.full(1 << 18, 4)
    tracemalloc.start()
    ids, after = gathered(flat, start, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids == flat).all() and after[-1] == 1 << 20
    assert peak < 20 << 20  # before, three 64-bit indexes: 24 MB and more
