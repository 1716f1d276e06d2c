"""Operator 4: language by hierarchical discrimination.

Linear support vector machines over hashed byte n-grams first tell language families
apart; inside the family that wins, one machine for each pair of its languages decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, schema_of, slices, table, tidy
from .grams import add_grams, joined, kept_sizes
from .samples import per_label, remainder, sample_texts

#: Families of closely related languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-iranian": "hi ur bn fa ps mr gu pa ne si ku",
    "semitic": "ar he am mt",
    "malayic": "id ms",
}
BITS = 13
#: Learned from: doc_ids of each language, languages (the most frequent), doc_ids in all; strictly twice that. So the
#: driver holds at most 2 * MOST_ROWS feature rows, whatever the number of languages.
SAMPLE, MOST_LANGUAGES, MOST_ROWS = 250, 256, 2000
FOLDS, HELD = 4, 2
#: Texts whose features stand in memory at once: their rows are 2**BITS floats wide.
ROWS = 256
ROUNDS, PENALTY, SLOPE = 150, 1e-4, 4.0
#: `least_sure` takes this quantile of held-out rows, and this share of it, so that learned languages stay; values count by
#: such steps from 0 to 1.
QUANTILE, SHARE, STEPS = 0.005, 0.8, 1 << 16
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def features(texts: pa.Array) -> np.ndarray:
    """(texts, 2**BITS) unit vectors of n-grams of 1 to 4 bytes over lower-cased words between single spaces."""
    data, ends = joined(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(texts)
    plain = _PLAIN[data]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    starts = ends[:-1][ends[:-1] < len(plain)]
    keep[starts] = True
    # a space before and after each text
    stops = np.concatenate([[0], np.cumsum(kept_sizes(keep, ends) + 2)])
    padded = np.full(int(stops[-1]), 32, np.uint8)
    inner = np.ones(len(padded), bool)
    inner[stops[:-1]] = inner[stops[1:] - 1] = False
    padded[inner] = plain[keep]
    X = np.zeros((n, 1 << BITS), np.float32)
    for k in (1, 2, 3, 4):
        add_grams(X, padded, stops, k, BITS, 0)
    np.log1p(X, out=X)
    X /= np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-9)
    return X


def machine(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the offset of a linear machine for signs y: squared hinge loss, both sides weighing the same."""
    X = np.column_stack([X, np.ones(len(X), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(X.shape[1], np.float32)
    step = 1 / (4.0 + PENALTY)
    for i in range(ROUNDS):
        ahead = w + (i / (i + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (X @ ahead))
        last, w = w, ahead + step * (2 * X.T @ (share * slack * y) - PENALTY * ahead)
    return w


class OneVersusOne:
    """A machine for each pair of names; the name with most wins is chosen, then with the larger margins."""

    def __init__(self, names: list[str], X: np.ndarray, labels: np.ndarray):
        self.names, self.pairs = [str(x) for x in names], list(combinations(range(len(names)), 2))
        self.weights = np.array([machine(X[m := np.isin(labels, [names[a], names[b]])], np.where(labels[m] == names[a], 1, -1).astype(np.float32)) for a, b in self.pairs]).reshape(len(self.pairs), X.shape[1] + 1)

    def decide(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chosen index, confidence: the winner's least sigmoid of a margin)."""
        if not self.pairs:
            return np.zeros(len(X), int), np.ones(len(X))
        margins = X @ self.weights[:, :-1].T + self.weights[:, -1]
        votes = np.zeros((len(X), len(self.names)))
        least = np.full((len(X), len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k].astype(np.float64)
            votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-SLOPE * least[np.arange(len(X)), best]))


class LanguageModel:
    def __init__(self, X: np.ndarray, langs: np.ndarray):
        families = np.array([family(x) for x in langs])
        self.upper = OneVersusOne(sorted(set(families)), X, families)
        self.lower = [OneVersusOne(sorted(set(langs[families == f])), X[families == f], langs[families == f]) for f in self.upper.names]
        self.centres = {str(x): (c := X[langs == x].mean(0)) / max(float(np.linalg.norm(c)), 1e-9) for x in sorted(set(langs))}

    def predict(self, X: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, sure = self.upper.decide(X)
        names: list[str] = [""] * len(X)
        score = sure.copy()
        for k, below in enumerate(self.lower):
            rows = np.flatnonzero(which == k)
            if len(rows):
                best, sure = below.decide(X[rows])
                score[rows] *= sure
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    names[r] = below.names[b]
        return names, score

    def fit(self, X: np.ndarray, names: list[str]) -> np.ndarray:
        """Cosine of each row to the mean row of its language: low for scripts and spellings that were not learned."""
        return np.array([float(x @ self.centres[n]) for x, n in zip(X, names, strict=True)])


def labelled(docs: DataFrame, held: bool, sample: int) -> DataFrame:
    """A bounded sample of documents with a language (doc_id, lang, text), of the held-out fold or of the others."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ((remainder(FOLDS) == HELD) == F.lit(held)))
    return sample_texts(known, per_label(known.select("doc_id", "lang"), "lang", sample, MOST_LANGUAGES, MOST_ROWS), ["doc_id", "lang"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learn from documents with a language outside the held-out fold; None where there are none.

    Driver memory: at most 2 * MOST_ROWS feature rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=ROWS):
            X = features(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "x": [row.tobytes() for row in X]})

    rows = labelled(docs, False, sample).select("lang", "text").mapInArrow(tidy(run), "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    X, langs = np.empty((len(rows), 1 << BITS), np.float32), np.array([r.lang for r in rows])
    for k, r in enumerate(rows):
        X[k] = np.frombuffer(r.x, np.float16)
    del rows
    return LanguageModel(X, langs)


def least_sure(docs: DataFrame, model: LanguageModel | None) -> tuple[float, float]:
    """(lang_score, lang_fit) that held-out rows predicted right hardly ever fall below; zeros where there are none.

    A score has a floor that the number of languages sets, and one learned language scores 1 always, so no fixed
    value tells an unlearned language. All held-out rows with a language count, by steps of 1 / STEPS. Driver memory:
    at most STEPS + 1 counts for each of the two.
    """
    held = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(FOLDS) == HELD)).select("text", "lang")
    right = predict_language(held, model).where("lang_pred = lang")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * STEPS).alias("step")) for k, c in enumerate(("lang_score", "lang_fit"))))).alias("x")
    counts = right.select(kinds).groupBy("x.kind", "x.step").count().collect()
    if not counts:
        return 0.0, 0.0
    return tuple(SHARE * _low(sorted((r.step, r["count"]) for r in counts if r.kind == k)) / STEPS for k in (0, 1))


def _low(counts: list[tuple[int, int]]) -> int:
    """The step that holds the QUANTILE of all rows."""
    ends = np.cumsum([n for _, n in counts])
    return counts[int(np.searchsorted(ends, QUANTILE * (ends[-1] - 1), side="right"))][0]


def predict_language(docs: DataFrame, model: LanguageModel | None, added: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_fit")) -> DataFrame:
    """`docs` with the predicted language, its score and its fit; `und` with zeros where a text is null or has no letter, or nothing was learned.

    `added` names the three; columns that have the names already are replaced. Memory: about 10 bytes for each of a text's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of 2**BITS weights
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=ROWS):
            text = pc.fill_null(b.column("text"), "")
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            if shared.value is None:
                langs, score, fit = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                X = features(text)
                langs, score = shared.value.predict(X)
                fit = np.where(letters, shared.value.fit(X, langs), 0.0)
                langs = [x if ok else UNKNOWN for x, ok in zip(langs, letters.tolist(), strict=True)]
                score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score), pa.array(fit)], [*names, *added])

    return docs.select(*names).mapInArrow(tidy(run), schema_of(docs, names, *(f"`{c}` {t}" for c, t in zip(added, ("string", "double", "double"), strict=True))))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in a language that was learned, about as certain and as like it as held-out documents are,
    with their own columns, whatever those are called."""
    added = tuple(fresh(docs, "lang_pred", "lang_score", "lang_fit"))
    model = learn(docs)
    score, fit = least_sure(docs, model)
    known = predict_language(docs, model, added)
    return known.where((F.col(added[0]) != UNKNOWN) & (F.col(added[1]) >= score) & (F.col(added[2]) >= fit)).select(docs.columns)


def op4_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; rows of the held-out fold are never learned from.

    A null doc_id is neither held out nor learned from; repeated rows are predicted each; a text of any length is
    read whole; an empty table gives no row. Tied languages: the first by name. Further columns take no part.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(FOLDS) == HELD, F.lit(False)).alias("held_out")
    return predict_language(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held, "lang_pred", F.col("lang_score").alias("score"))
