"""Blocks of vectors against a stream of queries: what operators 2 and 3 share.

All rows are dealt into blocks; each block is one task.  The queries are a table of their
own in the shared folder that every task reads piece by piece, so that nothing of them is
broadcast or joined, and memory holds one block and one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, scratch, tidy

QUERY_ROWS = 1024


def finite(c: str) -> F.Column:
    """Whether an array is not null and has neither null nor non-finite components."""
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def stored(vectors: DataFrame, every: int) -> tuple[DataFrame, str]:
    """The vectors with a number for each row (uid), and where those whose vec_id is divisible by `every` are; both in the shared folder."""
    rows = cut(vectors.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    path = scratch(vectors.sparkSession, "queries")
    rows.where(F.col("vec_id") % every == 0).select("vec_id", "uid", "embedding").write.parquet(path)
    return rows, path


def matrix(column: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), dims)


def query_pieces(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of the stored queries, some at a time."""
    fs, at = filesystem(path)
    files = sorted(f.path for f in fs.get_file_info(_selector(at)) if f.path.endswith(".parquet"))
    if files:
        yield from pads.dataset(files, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_ROWS)


def _selector(at: str):
    from pyarrow.fs import FileSelector

    return FileSelector(at)


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are, best first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def products(X: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inner products of rows with q, each summed in one order of its components: the same for equal rows, wherever they stand.

    A matrix product isn't: its last bits depend on a row's place.
    """
    return (X * q).sum(axis=1)


def search_blocks(rows: DataFrame, path: str, block_rows: int, prepare: Callable, k: int, score_type: str, by: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row.

    `prepare(ids, uids, X)` makes a block of one dimension ready and returns a function that yields, for query ids,
    uids and vectors, each query's (best ids, scores).
    """
    n = rows.count()
    parts = max(1, -(-n // block_rows))
    dealt = rows.repartitionByRange(parts, *by) if by and parts > 1 else rows.repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        held = pa.Table.from_batches(batches).combine_chunks()
        sizes = held.column("embedding").chunk(0).value_lengths().to_numpy()
        blocks = {}
        for dims in np.unique(sizes):
            part = held.filter(pa.array(sizes == dims)).combine_chunks()
            blocks[int(dims)] = prepare(part.column("vec_id").to_numpy(), part.column("uid").to_numpy(), matrix(part.column("embedding").chunk(0), int(dims)))
        for piece in query_pieces(path):
            if not piece.num_rows:
                continue
            lengths = piece.column("embedding").value_lengths().to_numpy()
            for dims in np.unique(lengths):
                if int(dims) not in blocks:
                    continue
                mine = piece.filter(pa.array(lengths == dims))
                qid, quid = mine.column("vec_id").to_numpy(), mine.column("uid").to_numpy()
                got = list(blocks[int(dims)](qid, quid, matrix(mine.column("embedding"), int(dims))))
                counts = [len(a) for a, _ in got]
                if sum(counts):
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(qid, counts)), "quid": pa.array(np.repeat(quid, counts)), "vec_id": pa.array(np.concatenate([a for a, _ in got])), "score": pa.array(np.concatenate([s for _, s in got]))})

    found = dealt.select("vec_id", "uid", "embedding").mapInArrow(tidy(run), f"query_id long, quid long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id", "quid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
