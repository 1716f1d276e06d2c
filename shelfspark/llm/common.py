"""Shared folders, executor-side files and batch helpers of the corpus operators.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder.  Only
a session on one machine (tests) may go without the setting: it gets a temporary
folder.  On a cluster a missing setting is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that a Python worker handles at once, whatever an Arrow batch holds.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 4096
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a session on one machine has none, a new local one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/shelfspark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: nothing upstream is ever computed twice."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")  # the table is the copy that counts: its shuffle files go with the write's end
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before) if before is not None else spark.conf.unset(DROP_SHUFFLES)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def drop(*frames: DataFrame) -> None:
    """Delete tables that `cut` wrote, after their last reader has ended."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            fs, at = filesystem(path)
            fs.delete_dir(at)
            df._scratch = None


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until no column of `df` has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def schema_of(df: DataFrame, names: list[str], *added: str) -> str:
    """DDL of some of the columns of `df` and of added ones, for an Arrow function."""
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *added])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI and the path in it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def join_uri(uri: str, *parts: str) -> str:
    return "/".join([uri.rstrip("/"), *parts])


def put_file(folder: str, name: str, chunks: Iterator[bytes], attempt: str) -> int:
    """Write a file under a temporary name and move it into place, so that a lost or repeated task leaves it whole.

    Returns the number of bytes.
    """
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    tmp, size = f"{at}/_{name}.{attempt}", 0
    with fs.open_output_stream(tmp, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(tmp, f"{at}/{name}")
    return size


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of at most `rows` rows and about `limit` bytes in `column`; a longer row stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        ends, at = np.cumsum(sizes), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Have executors collect their garbage, which gives the heap that earlier stages grew back to the system: Python workers need
    that memory next. A session that allows no such call goes on without."""
    n = max(1, spark.sparkContext.defaultParallelism)
    with contextlib.suppress(AnalysisException):
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def key_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = False) -> Iterator[pa.Table]:
    """Runs of rows with the same keys; with `whole` those that end in one batch come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(c).to_numpy() for c in keys])
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])).tolist()
        if whole and len(starts) > 1:
            starts = [0, starts[-1]] if tuple(k[0].tolist()) != last or not held else [0, starts[1], starts[-1]] if len(starts) > 2 else starts
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(k[s].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[e - 1].tolist())
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def in_buckets(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The buckets that occur, ascending; for each column of rows the bytes of each bucket's rows, one after the other."""
    order = np.argsort(bucket)
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    ends, found = np.append(at, len(bucket)), [pa.array(bucket[at].astype(np.int64))]
    for rows in columns:
        rows = np.ascontiguousarray(rows[order])
        found.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((rows.strides[0] * ends).astype(np.int32)), pa.py_buffer(rows)]))
    return found


#: Join keys that one key's rows are spread over.
SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """A join for a `left` in which one key may hold a large share of the rows: its rows get one of SALTS salts,
    from a hash of the columns `by` (all by default), and each row of `right`, whose keys are distinct, comes once for each salt."""
    salt = F.pmod(F.xxhash64(*(by or left.columns)), F.lit(SALTS))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


#: Rows from which a key is hot.
HOT = 10_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, by: list[str]) -> DataFrame:
    """A join of sides that both say how many rows a key has (`rows`): those of hot keys are spread over salts by a hash of
    `by`, and only for them `right`, whose keys are distinct, comes once for each salt."""
    hot = F.col(rows) > HOT
    salted = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop(rows)
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
