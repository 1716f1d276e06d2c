"""Operator 3: exact largest inner products over buckets of vectors of similar length.

Rows are sorted by length and cut into buckets.  For a query q with the k-th best score
so far s, a bucket whose longest row has length l needs a cosine of s / (|q| l): above 1
the bucket is skipped, and so are all after it.  A high threshold makes coordinates
telling: a row of a cosine t at least with q keeps its unit coordinate f within
q_f t +- sqrt((1 - q_f^2)(1 - t^2)), so rows outside on q's largest coordinates are left
out.  A low one makes that vain, and only rows that are too short are left out.  What
remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import finite, search_blocks, stored, top_k

BUCKET_ROWS, BLOCK_ROWS = 1024, 1 << 13
#: Local cosine thresholds from which coordinates are used, and how many of a query's largest.
COORDINATES_FROM, FOCUS = 0.8, 4
#: Room for rounding in the pruning bounds; the products themselves are exact.
SLACK = 1e-9
SCALE, K, EVERY = 256, 5, 50
_LONG = (1 << 63) - 1


def exact_products(X: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of integer-valued doubles: in doubles where that is exact, else in Python's integers; one beyond a long is an error."""
    if X.shape[1] * np.abs(X).max(initial=0) * np.abs(q).max(initial=0) < 2**53:
        return (X @ q).astype(np.int64)
    ints = [int(x) for x in q]
    found = [sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in X]
    if not all(-_LONG - 1 <= x <= _LONG for x in found):
        raise OverflowError("an integer product of two vectors is beyond a long")
    return np.array(found, np.int64)


class NormBuckets:
    """Buckets over the rows of X, longest first."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, X: np.ndarray, bucket_rows: int = BUCKET_ROWS):
        lengths = np.linalg.norm(X, axis=1)
        order = np.lexsort((ids, -lengths))
        self.ids, self.uids, self.X, self.lengths = ids[order], uids[order], X[order], lengths[order]
        self.units = self.X / np.maximum(self.lengths, np.finfo(float).tiny)[:, None]
        self.cuts = [(a, min(a + bucket_rows, len(X))) for a in range(0, len(X), bucket_rows)]
        self.verified = 0

    def candidates(self, a: int, b: int, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows of bucket a..b that may score `least` or more; None: neither this bucket nor a later one has any."""
        longest = self.lengths[a]
        if least <= 0:
            return np.arange(a, b)  # no pruning by cosine below 0
        if length == 0 or longest == 0:
            return None  # every product is 0
        t = least / (length * longest) - SLACK
        if t > 1:
            return None
        end = a + int(np.searchsorted(-self.lengths[a:b], -(least / length) * (1 - SLACK), side="right"))
        if t < COORDINATES_FROM:
            return np.arange(a, end)
        rows = np.arange(a, end)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt(max(0.0, 1 - unit[f] ** 2) * max(0.0, 1 - t * t))
            low = -1.0 if unit[f] <= -t else unit[f] * t - spread  # the cone around q may hold the axis itself
            high = 1.0 if unit[f] >= t else unit[f] * t + spread
            rows = rows[(self.units[rows, f] >= low - SLACK) & (self.units[rows, f] <= high + SLACK)]
        return rows

    def search(self, q: np.ndarray, quid: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but `quid`; rows certain to score below `floor` may be left out."""
        length = float(np.linalg.norm(q))
        unit = q / length if length else q
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = floor
        for a, b in self.cuts:
            rows = self.candidates(a, b, unit, length, least)
            if rows is None:
                break
            rows = rows[self.uids[rows] != quid]
            got = exact_products(self.X[rows], q)
            self.verified += len(rows)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, got])
            best = top_k(scores, ids, k)
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                least = max(floor, float(scores[-1]))
        return ids, scores


def largest_products(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer products over all other rows."""
    valid = vectors.where(F.col("vec_id").isNotNull() & finite("embedding"))
    # lengths before rounding deal the rows out well enough
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows, path = stored(valid.select("vec_id", "embedding", square.alias("norm2")), every)
    # the longest rows of all give every block a threshold to start from; at most BUCKET_ROWS rows
    # they are merged by a task, not by the driver
    seeds = cut(rows.orderBy(F.desc("norm2"), "uid").limit(BUCKET_ROWS).select("vec_id", "uid", "embedding"), "longest").collect()
    shared = rows.sparkSession.sparkContext.broadcast([(r.vec_id, r.uid, r.embedding) for r in seeds])

    def prepare(ids: np.ndarray, uids: np.ndarray, X: np.ndarray):
        buckets = NormBuckets(ids, uids, np.floor(scale * X))
        same = [s for s in shared.value if len(s[2]) == X.shape[1]]
        seed = NormBuckets(np.array([s[0] for s in same]), np.array([s[1] for s in same]), np.floor(scale * np.array([s[2] for s in same], np.float64).reshape(len(same), X.shape[1])))

        def search(qids: np.ndarray, quids: np.ndarray, Q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for uid, q in zip(quids, np.floor(scale * Q), strict=True):
                _, known = seed.search(q, uid, k)
                yield buckets.search(q, uid, k, float(known[-1]) if len(known) == k else -np.inf)

        return search

    return search_blocks(rows, path, block_rows, prepare, k, "long", by=[F.desc("norm2"), F.xxhash64("uid")])


def op3_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every row of `embeddings` whose vec_id is divisible by 50.

    Rows without vec_id and vectors that are null or hold null or non-finite components take no part; vectors
    of different dimensions are not compared; a product beyond a long ends the query with an error, as an overflow
    does in SQL. Repeated rows count each; only the query's own row is left out. An empty table gives no row.
    """
    return largest_products(table(spark, sf_dir, "embeddings"))
