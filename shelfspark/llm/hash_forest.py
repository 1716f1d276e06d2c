"""Operator 2: approximate nearest neighbours by a forest of sorted hash strings.

Inner products become cosines by one more coordinate: a row of length l among rows of
length m at most gets sqrt(m*m - l*l), a query 0.  Each tree hashes a row to a long bit
string, a bit for each random hyperplane, and keeps the strings sorted: the rows that
share a prefix with a query are one run of the array.  A query descends each tree to
its longest matching prefix; then all trees ascend together, one bit at a time, and
their runs widen until enough different rows are met.  Those are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import finite, products, search_blocks, stored, top_k

TREES, BITS, SEED = 64, 32, 20
#: Rows that a query meets before its trees stop: this share of a block, and so many times k at least.
#: Random vectors of 64 dimensions have no near neighbours to speak of and need about this for a recall of 0.95.
SHARE, TIMES_K = 0.3, 20
BLOCK_ROWS = 1 << 13
K, EVERY = 20, 20


class HashForest:
    """A forest over the rows of X."""

    def __init__(self, X: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.X, self.bits = X, bits
        lengths = np.linalg.norm(X, axis=1)
        longest = max(lengths.max(initial=0), np.finfo(float).tiny)
        self.seed, self.trees = seed, trees
        wide = np.column_stack([X / longest, np.sqrt(np.maximum(0, 1 - (lengths / longest) ** 2))])
        self.order, self.sorted = np.empty((trees, len(X)), np.int32), np.empty((trees, len(X)), np.uint64)
        for t in range(trees):
            codes = self.strings(wide, t)
            self.order[t] = np.argsort(codes, kind="stable")
            self.sorted[t] = codes[self.order[t]]

    def strings(self, wide: np.ndarray, tree: int) -> np.ndarray:
        """The rows' bit strings in a tree as integers, first bit highest."""
        planes = np.random.default_rng((self.seed, wide.shape[1], tree)).standard_normal((wide.shape[1], self.bits))
        return (wide @ planes > 0) @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def runs(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, trees, queries): where the run of each prefix length starts and ends; empty below the longest match."""
        wide = np.column_stack([Q, np.zeros(len(Q))])
        starts = np.empty((self.bits + 1, self.trees, len(Q)), np.int32)
        ends = np.empty_like(starts)
        for t in range(self.trees):
            codes = self.strings(wide, t)
            for level in range(self.bits + 1):
                step = np.uint64(self.bits - level)
                low = codes >> step << step
                starts[level, t] = np.searchsorted(self.sorted[t], low)
                ends[level, t] = np.searchsorted(self.sorted[t], low + (np.uint64(1) << step))
        return starts, ends

    def candidates(self, starts: np.ndarray, ends: np.ndarray, enough: int) -> np.ndarray:
        """The rows one query meets: runs of all trees, from the longest matches upwards."""
        met = np.zeros(len(self.X), bool)
        total = (ends - starts).sum(axis=1)
        level = int(np.flatnonzero(total)[-1])  # the longest match of any tree
        level = max((x for x in range(level + 1) if total[x] >= enough), default=0)  # fewer can't be enough
        while True:
            for t in range(self.trees):
                met[self.order[t, starts[level, t] : ends[level, t]]] = True
            if level == 0 or np.count_nonzero(met) >= enough:
                return np.flatnonzero(met)
            level -= 1


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE, block_rows: int = BLOCK_ROWS, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best of the rows met; queries: vec_id divisible by `every`."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows, path = stored(vectors.where(F.col("vec_id").isNotNull() & finite("embedding") & nonzero).select("vec_id", "embedding"), every)

    def prepare(ids: np.ndarray, uids: np.ndarray, X: np.ndarray):
        forest, at = HashForest(X, trees), {u: i for i, u in enumerate(uids.tolist())}
        enough = min(len(X), max(int(share * len(X)), TIMES_K * k))
        longest = float(np.linalg.norm(X, axis=1).max(initial=0))

        def search(qids: np.ndarray, quids: np.ndarray, Q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(Q), 256):
                starts, ends = forest.runs(Q[a : a + 256])
                for i, q in enumerate(Q[a : a + 256]):
                    rows = forest.candidates(starts[:, :, i], ends[:, :, i], enough)
                    own = at.get(int(quids[a + i]))
                    if own is not None:
                        rows = rows[rows != own]
                    if len(rows) > k:  # rounding can't move those far below the k-th best among the best
                        rough = X[rows] @ q
                        room = 1e-12 * longest * float(np.linalg.norm(q))
                        rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - room]
                    scores = products(X[rows], q)
                    best = top_k(scores, ids[rows], k)
                    yield ids[rows[best]], scores[best]

        return search

    return search_blocks(rows, path, block_rows, prepare, k, "double")


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row of `embeddings` whose vec_id is divisible by 20.

    Rows without vec_id and null, zero, empty or not finite vectors take no part; vectors of different dimensions
    are not compared. Each query row is answered, rows that repeat a vec_id too; only the row itself is left out.
    Equal vectors score alike to the last bit, and ties go to the smaller vec_id. An empty table gives no row.
    """
    return nearest(table(spark, sf_dir, "embeddings"))
