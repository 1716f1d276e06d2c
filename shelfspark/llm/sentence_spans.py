"""Operator 8: text that repeats across a corpus, found by sliding runs of sentences.

From every sentence on, the shortest run of at least RUN sentences and LEAST_WORDS words
is hashed.  A run that occurs before, in document order and position, is a repeat, and
the sentences under it are removed; the first occurrence stays whole.  Sentences end
after . ! ? or a full-width stop at the end of a word, and at line ends.

What a passage's first and last sentence are depends on the text they are glued to, and
text without stops is one sentence.  So pieces make runs as well: a piece ends after
every word that has the least hash of some NEAR words in a row, so that equal passages
are cut alike but for the NEAR - 1 words at either end, and no piece has more than NEAR
words.  From every piece on, the shortest run of at least PIECE_WORDS words is hashed: a
passage of 51 words shares one, whatever stands around it.  Runs whose whole sentences
hold a run already are left out, which is told by the run's own words.

Runs are compared by 128 bits of a hash of their words.  A-Z count as a-z and white space
between words as one, so a passage in capitals or with other line breaks is a repeat too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, hot_join, in_buckets, key_blocks, schema_of, slices, table, tidy
from .grams import joined
from .shingles import Words, range_hashes, words_of

RUN, LEAST_WORDS = 3, 15
PIECE_WORDS, NEAR = 30, 5
#: Whole runs that are dealt out at once: one for so many bytes of text, about what it takes on disk, and so many at least.
PASS_BYTES, PASS_RUNS = 28, 1 << 20
#: Buckets that halves are counted in, and halves that a task holds until it deals them out.
BUCKETS, HELD_RUNS = 4096, 1 << 18


@dataclass
class Sentences:
    """The pieces, sentences and runs of a batch of texts. `first` and `first_run` have where each text starts, and the end."""

    first: np.ndarray
    begin: np.ndarray  # first byte of each piece, in all texts' bytes
    sentence: np.ndarray  # number of each piece's sentence
    first_run: np.ndarray
    run_start: np.ndarray  # pieces, ascending
    run_end: np.ndarray  # the piece after the run
    run_hash: np.ndarray  # two rows


def least_of_near(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words that are the least, the last of equal ones, of NEAR words in a row of one text."""
    n = len(hashes) - NEAR + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.zeros(n, np.int8)
    for d in range(1, NEAR):
        other = hashes[d : n + d]
        less = other <= least
        least[less], place[less] = other[less], d
    inside = np.ones(n, bool)
    for end in at[1:-1].tolist():  # windows that begin before a text's end and end after it
        inside[max(0, end - NEAR + 1) : end] = False
    return np.flatnonzero(inside) + place[inside]


def ends_of_sentences(data: np.ndarray, words: Words) -> np.ndarray:
    """Whether each word ends a sentence."""
    at, s, e = words.at, words.start, words.end
    if not len(s):
        return np.zeros(0, bool)
    last = data[e - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    wide = np.flatnonzero((last == 0x82) & (e - s >= 3))
    stop[wide] |= (data[e[wide] - 2] == 0x80) & (data[e[wide] - 3] == 0xE3)
    lines = np.flatnonzero(data == 10)
    stop[:-1] |= np.searchsorted(lines, s[1:]) > np.searchsorted(lines, e[:-1])
    stop[at[1:][at[1:] > at[:-1]] - 1] = True
    return stop


def count_sentences(texts: pa.Array) -> np.ndarray:
    """How many sentences each text has."""
    data, ends = joined(texts)
    words = words_of(data, ends, lanes=0)
    return np.diff(np.concatenate([[0], np.cumsum(ends_of_sentences(data, words))])[words.at])


def split(texts: pa.Array, lanes: int = 2) -> tuple[np.ndarray, np.ndarray, Sentences]:
    """(bytes of all texts, where each starts, sentences); the runs' hashes have `lanes` rows, none for 0."""
    data, ends = joined(texts)
    found = words_of(data, ends, max(1, lanes))
    words, at, s = found.hashes, found.at, found.start
    n = len(s)
    if not n:
        none = np.zeros(len(ends), np.int64)
        return data, ends, Sentences(none, s, s, none, s, s, words)
    stop = ends_of_sentences(data, found)
    piece = stop.copy()
    piece[least_of_near(words[0], at)] = True
    start = np.concatenate([[0], np.flatnonzero(piece[:-1]) + 1])  # first word of each piece
    opens = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])  # first word of each sentence
    first = np.searchsorted(start, at)
    # runs of sentences, as first words and words after the last
    m, opened = len(opens), np.append(opens, n)
    to = np.maximum(np.searchsorted(opened, opens + LEAST_WORDS), np.arange(m) + RUN)
    of = np.searchsorted(opens, at)
    ok = to <= np.repeat(of[1:], np.diff(of))
    a, b = opens[ok], opened[to[ok]]
    # runs of pieces
    starts = np.append(start, n)
    to = np.searchsorted(starts, start + PIECE_WORDS)
    ok = to <= np.repeat(first[1:], np.diff(first))
    pstart, pend = start[ok], starts[to[ok]]
    stops = np.flatnonzero(stop)
    k, last = np.searchsorted(stops, pstart), np.searchsorted(stops, pend - 1) - 1  # the first and the last stop before the last word
    more = (last - k < RUN) | (stops[np.maximum(last, 0)] - stops[np.minimum(k, len(stops) - 1)] < LEAST_WORDS)
    runs = np.concatenate([a * (n + 1) + b, pstart[more] * (n + 1) + pend[more]])
    runs.sort(kind="stable")  # two sorted lists
    runs = runs[np.concatenate([[True], runs[1:] != runs[:-1]])[: len(runs)]]
    a, b = runs // (n + 1), runs % (n + 1)
    h = np.array([range_hashes(w, a, b) for w in words[:lanes]], np.uint64).reshape(lanes, len(a))
    return data, ends, Sentences(first, s[start], np.searchsorted(opens, start, side="right") - 1, np.searchsorted(a, at), np.searchsorted(start, a), np.searchsorted(starts, b), h)


def _text_hash() -> F.Column:
    """Of a text: rows that agree in doc_id and text are one document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def first_halves(docs: DataFrame, size: Accumulator[int], runs: Accumulator[int]) -> DataFrame:
    """(bucket, halves, met): the first halves of the hashes of all runs as 64-bit integers, dealt to BUCKETS by hash, and how often each
    was met as 32-bit ones; equal ones of HELD_RUNS are one. Adds the texts' bytes to `size` and the runs to `runs`."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        h.sort()
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.RecordBatch.from_arrays(in_buckets(h[at] % np.uint64(BUCKETS), h[at], np.diff(np.append(at, len(h))).astype(np.int32)), ["bucket", "halves", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in slices(batches):
            data, _, sent = split(b.column("text"), lanes=1)
            size.add(len(data))
            runs.add(sent.run_hash.shape[1])
            if sent.run_hash.shape[1]:
                held.append(sent.run_hash[0])
                n += len(held[-1])
            if n >= HELD_RUNS:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    return docs.select("text").mapInArrow(tidy(run), "bucket long, halves binary, met binary")


def counted(halves: DataFrame) -> DataFrame:
    """(h, rows): the halves that several runs have and how many. Memory: about 60 bytes for each half of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets in key_blocks(batches, ["bucket"], whole=True):
            h, n = (np.frombuffer(b"".join(buckets.column(c).to_pylist()), kind) for c, kind in (("halves", np.int64), ("met", np.int32)))
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            rows = np.add.reduceat(n, at, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"h": h[at][rows > 1], "rows": rows[rows > 1]})

    return halves.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "h long, rows long")


def spans(docs: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(h, g, doc_id, th, at): both halves of the hash of every run and its number in the text; of the runs whose h is `part` modulo `parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, _, sent = split(b.column("text"))
            h, g = sent.run_hash.view(np.int64)
            rows = np.flatnonzero(h % parts == part)
            owner = np.searchsorted(sent.first_run, rows, side="right") - 1
            take = pa.array(owner)
            h, g = h[rows], g[rows]
            yield pa.RecordBatch.from_pydict({"h": h, "g": g, "doc_id": b.column("doc_id").take(take), "th": b.column("th").take(take), "at": (rows - sent.first_run[owner]).astype(np.int32)})

    return docs.select("doc_id", "text", _text_hash().alias("th")).mapInArrow(tidy(run), "h long, g long, doc_id long, th long, at int")


def repeated_halves(docs: DataFrame) -> tuple[DataFrame, int]:
    """((h, rows): the halves that several runs have and how many, in the shared folder; in how many passes whole runs are dealt out)."""
    sc = docs.sparkSession.sparkContext
    size, runs = sc.accumulator(0), sc.accumulator(0)
    several = cut(counted(first_halves(docs, size, runs)), "repeated-halves")
    return several, max(1, -(-runs.value // max(PASS_RUNS, size.value // PASS_BYTES)))  # a repeated task counts again in both


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, th, starts): the runs of each document that are repeats of an earlier one, in the shared folder.

    Half hashes are counted before anything is joined, so a run that a third of the corpus shares is one row for each
    task; whole runs come back for the halves that several have, with how many rows have them, which tells hot keys.
    They come in passes by their half, so that about as much as the texts is on disk at once, however short the pieces are.
    """
    several, parts = repeated_halves(docs)
    place, found = F.struct("doc_id", "th", "at"), []
    for part in range(parts):
        shared = cut(spans(docs, part, parts).join(several.where(F.pmod("h", F.lit(parts)) == part), "h"), "shared-runs")
        first = shared.groupBy("h", "g").agg(F.min(place).alias("low"), F.count("*").alias("n"), F.max("rows").alias("rows")).where("n > 1").select("h", "g", "low", "rows")
        again = hot_join(shared, first, ["h", "g"], "rows", ["doc_id", "th", "at"]).where(~place.eqNullSafe(F.col("low")))
        found.append(cut(again.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("starts")), "repeats"))
        drop(shared)
    drop(several)
    if parts == 1:
        return found[0]
    starts = cut(functools.reduce(DataFrame.unionByName, found).groupBy("doc_id", "th").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts")), "repeats")
    drop(*found)
    return starts


def remove_repeats(docs: DataFrame, added: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """`docs` with text without repeats, its sentences and how many of them lost words; a text without repeats stays as it is, null stays null.

    `added` names the two; columns that have the names already are replaced. Memory: about 25 bytes for each of a text's.
    """
    names = [c for c in docs.columns if c != "text" and c.lower() not in {x.lower() for x in added}]
    own_id, own_th, starts_at = fresh(docs, "_doc", "_th", "_starts")
    found = repeats(docs).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("starts").alias(starts_at))
    both = docs.select(*names, "text").join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (_text_hash() == F.col(own_th)), "left").select(*names, "text", starts_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            given, starts = b.column("text"), b.column(starts_at).to_pylist()
            counts, texts, removed = count_sentences(given), given, np.zeros(b.num_rows, np.int64)
            if marked := [i for i, marks in enumerate(starts) if marks]:
                data, ends, sent = split(given.take(pa.array(marked)), lanes=0)
                texts = given.to_pylist()
                for j, i in enumerate(marked):
                    lo, hi = int(sent.first[j]), int(sent.first[j + 1])
                    edge = np.zeros(hi - lo + 1, np.int32)
                    marks = sent.first_run[j] + np.array(starts[i])
                    np.add.at(edge, sent.run_start[marks] - lo, 1)
                    np.add.at(edge, sent.run_end[marks] - lo, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    begin = np.append(sent.begin[lo:hi], ends[j + 1])
                    begin[0] = ends[j]
                    keep = np.repeat(~gone, np.diff(begin))
                    texts[i] = data[ends[j] : ends[j + 1]][keep].tobytes().decode("utf-8")
                    removed[i] = len(np.unique(sent.sentence[lo:hi][gone]))
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), texts, pa.array(counts), pa.array(removed)], [*names, "text", *added])

    return both.mapInArrow(tidy(run), schema_of(docs, names, "text string", *(f"`{c}` long" for c in added)))


def keep_new(docs: DataFrame) -> DataFrame:
    """`docs` without repeated passages and without documents of nothing else; n_chars, where it is a column, follows the text."""
    added = tuple(fresh(docs, "n_sentences", "n_removed"))
    lost = F.col(added[1]) > 0
    cleaned = remove_repeats(docs, added).where(~lost | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(docs.columns)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier passage.

    Order is by doc_id (null first), a hash of the text, position. Rows that agree in doc_id and text are one
    document and keep the same sentences. Null and empty texts pass through; a text of repeats alone becomes empty;
    an empty table gives no row. A passage that differs in the case of A-Z or in white space alone is a repeat.
    """
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_sentences", "n_removed")
