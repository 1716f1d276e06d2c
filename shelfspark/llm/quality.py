"""Operator 1: quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte trigrams, of trigrams of its character classes and a
share of distinct words.  Weighted by rarity and projected on the largest singular
directions of a sample of labelled texts, that is a short unit vector.  The sample's
vectors are broadcast; every document is compared with all of them by blocks of products,
and the most similar ones vote with their labels, weighted by a power of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, schema_of, slices, table, tidy
from .grams import add_grams, joined, shapes, word_repeats
from .samples import per_label, remainder, sample_texts

BYTE_BITS, SHAPE_BITS, REPEAT_BINS = 12, 10, 16
WIDTH = (1 << BYTE_BITS) + (1 << SHAPE_BITS) + REPEAT_BINS
#: How much the three kinds of features count.
WEIGHTS = (0.3, 1.0, 0.7)
#: Labelled rows of each label that are learned from, directions kept, neighbours that vote, the power of the cosine.
SAMPLE, DIRECTIONS, NEIGHBOURS, POWER = 600, 48, 15, 4
FOLDS, THRESHOLD = 5, 0.3
#: Texts whose features stand in memory at once: their rows are WIDTH floats wide.
ROWS = 256


def features(texts: pa.Array) -> np.ndarray:
    """(texts, WIDTH) logarithmic counts."""
    data, ends = joined(texts)
    n = len(texts)
    X = np.zeros((n, WIDTH), np.float32)
    add_grams(X, data, ends, 3, BYTE_BITS, 0)
    add_grams(X, *shapes(data, ends), 3, SHAPE_BITS, 1 << BYTE_BITS)
    words, distinct = word_repeats(texts)
    share = np.minimum(REPEAT_BINS - 1, REPEAT_BINS * distinct // np.maximum(words, 1))
    X[np.arange(n), (1 << BYTE_BITS) + (1 << SHAPE_BITS) + share] = words
    return np.log1p(X, out=X)


@dataclass
class Model:
    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # what each labelled row's vote counts for label 1 and for label 0
    prior: float

    def project(self, X: np.ndarray) -> np.ndarray:
        """Unit latent vectors; of an empty text all zeros."""
        P = _weighted(X, self.rarity) @ self.directions
        return P / np.maximum(np.linalg.norm(P, axis=1, keepdims=True), 1e-9)

    def scores(self, X: np.ndarray) -> np.ndarray:
        cosines = self.project(X) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER
        ones, zeros = (weight * self.votes[0][near]).sum(1), (weight * self.votes[1][near]).sum(1)
        return np.where(ones + zeros > 0, ones / np.maximum(ones + zeros, 1e-300), self.prior)


def _weighted(X: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    Z, at = X * rarity, 0
    for width, weight in zip((1 << BYTE_BITS, 1 << SHAPE_BITS, REPEAT_BINS), WEIGHTS, strict=True):
        part = Z[:, at : at + width]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += width
    return Z


def fit(X: np.ndarray, labels: np.ndarray, totals: dict[int, int]) -> Model:
    """`totals`: how many labelled rows there are of each label, of which X is a sample."""
    rarity = (np.log((1 + len(X)) / (1 + (X > 0).sum(0))) + 0.3).astype(np.float32)
    Z = _weighted(X, rarity)
    values, left = np.linalg.eigh((Z @ Z.T).astype(np.float64))
    k = min(DIRECTIONS, int((values > 1e-6 * max(values[-1], 1e-9)).sum()))
    directions = (Z.T @ (left[:, len(values) - k :] / np.sqrt(values[len(values) - k :]))).astype(np.float32)
    weight = {y: totals[y] / max(1, (labels == y).sum()) for y in (0, 1)}
    votes = np.array([weight[1] * (labels == 1), weight[0] * (labels == 0)])
    model = Model(rarity, directions, np.zeros((0, k), np.float32), votes, totals[1] / max(1, sum(totals.values())))
    model.vectors = model.project(X)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled rows outside the held-out fold; None where there are none.

    A doc_id with several labels counts once, with the larger. Driver memory: at most 4 * `sample` feature rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(FOLDS) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = sample_texts(docs, per_label(known, "quality", sample, 2, 2 * sample), ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=ROWS):
            X = features(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"quality": b.column("quality"), "x": [row.tobytes() for row in X]})

    rows = texts.select("quality", "text").mapInArrow(tidy(run), "quality int, x binary").collect()  # bounded by the sample
    if not rows:
        return None
    totals = {0: 0, 1: 0} | {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows.sort(key=lambda r: (r.quality, bytes(r.x)))
    X, y = np.empty((len(rows), WIDTH), np.float32), np.array([r.quality for r in rows])
    for k, r in enumerate(rows):
        X[k] = np.frombuffer(r.x, np.float16)
    del rows
    return fit(X, y, totals)


def score_quality(docs: DataFrame, model: Model | None, added: str = "quality_score") -> DataFrame:
    """`docs` with a score; without a model every score is 1 and nothing is rejected.

    `added` names the score; a column that has the name already is replaced. Memory: about 10 bytes for each of a text's.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 4 * SAMPLE vectors of DIRECTIONS floats, and the directions
    names = [c for c in docs.columns if c.lower() != added.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=ROWS):
            s = shared.value.scores(features(b.column("text"))) if shared.value else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s)], [*names, added])

    return docs.select(*names).mapInArrow(tidy(run), schema_of(docs, names, f"`{added}` double"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score THRESHOLD or more, with their own columns, whatever those are called."""
    (added,) = fresh(docs, "quality_score")
    return score_quality(docs, learn(docs, labels), added).where(F.col(added) >= THRESHOLD).select(docs.columns)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; labels of the held-out fold are never seen.

    Null and empty texts have no similar neighbour and score the share of label 1. A null doc_id is not held out.
    Repeated rows are scored each; an empty table gives no row. Of neighbours tied at the last place any vote.
    Further columns take no part, whatever their names.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held = F.coalesce(remainder(FOLDS) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
