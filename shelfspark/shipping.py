"""Brings this package to executors whose Python path lacks it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
#: What a Python worker gets at once, where the session says nothing else: both sides hold some batches in memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip to the session's Python files, once for each application, and bound its Arrow batches."""
    sc = spark.sparkContext
    for name, value in BATCHES.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SENT.add(sc.applicationId)
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that ships the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run
