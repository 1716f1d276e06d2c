"""Operator 9: best-fit packing of documents into sequences by a grouping genetic algorithm.

Only the lengths matter to a packing, and there are at most `capacity` of them.  So a
solution is a list of (pattern, copies): a pattern is the contents of a bin as (length,
how many) pairs, and its copies are bins of the same contents.  Best fit on that form
makes about one new pattern for each length, whatever the number of documents: the
state of the search is bounded by the capacity.  A gene of the grouping algorithm is a
pattern with its copies: crossover injects whole well-filled bins of one parent into
the other, bins that hold items twice are removed, and the displaced items are put
back by best fit.  Islands evolve as Spark tasks; between epochs the best solutions
move on to the next island.
"""

from __future__ import annotations

import json
import random
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_ids, cut, slices, table, tidy
from .tokens import ENCODE_BYTES, library_encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Islands, solutions on each, generations between two migrations, migrations, solutions that move on.
ISLANDS, POPULATION, GENERATIONS, EPOCHS, ELITE = 4, 4, 6, 3, 1

Pattern = tuple[tuple[int, int], ...]
Solution = list[tuple[Pattern, int]]


def fill(pattern: Pattern) -> int:
    return sum(size * k for size, k in pattern)


def bins(solution: Solution) -> int:
    return sum(m for _, m in solution)


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller the full ones (mean squared fill)."""
    return -bins(solution), sum(m * (fill(p) / capacity) ** 2 for p, m in solution) / max(1, bins(solution))


def best_fit(items: dict[int, int], capacity: int, opened: Solution = (), order: list[int] | None = None) -> Solution:
    """Put items (length -> how many) into `opened` bins and new ones, longest first or in the given order.

    Each item goes where the least room is left; a bin takes as many of a length as fit.
    """
    by_room: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def keep(contents: dict[int, int], copies: int, room: int) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((contents, copies))

    for pattern, copies in opened:
        keep(dict(pattern), copies, capacity - fill(pattern))
    for size in order if order is not None else sorted(items, reverse=True):
        left = items.get(size, 0)
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                k = capacity // size
                contents, copies, room = {}, -(-left // k), capacity
            else:
                room = rooms[at]
                contents, copies = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            k = min(room // size, left)
            used = min(copies, left // k)
            if at < len(rooms) + 1 and contents and used < copies:
                keep(contents, copies - used, room)
            keep(contents | {size: contents.get(size, 0) + k}, used, room - k * size)
            left -= used * k
    merged: dict[Pattern, int] = defaultdict(int)
    for room in rooms:
        for contents, copies in by_room[room]:
            merged[tuple(sorted(contents.items(), reverse=True))] += copies
    return list(merged.items())


def crossover(first: Solution, second: Solution, items: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """A child of `first` with whole well-filled bins of `second`."""
    left = dict(items)
    child: dict[Pattern, int] = defaultdict(int)
    full = [(p, m) for p, m in second if fill(p) >= capacity - capacity // 64]
    for pattern, copies in full:
        if rng.random() < 0.5:
            copies = min(copies, *(left[s] // k for s, k in pattern))
            if copies:
                child[pattern] += copies
                for s, k in pattern:
                    left[s] -= k * copies
    mine = sorted(first, key=lambda x: (-fill(x[0]), rng.random()))
    worst = len(mine) - max(1, len(mine) // 20)
    for i, (pattern, copies) in enumerate(mine):
        copies = min(copies, *(left[s] // k for s, k in pattern))  # the rest would hold items twice
        if i >= worst:
            copies //= 2  # mutation: bins with most room give up half of their copies
        if copies:
            child[pattern] += copies
            for s, k in pattern:
                left[s] -= k * copies
    loose = {s: n for s, n in left.items() if n}
    order = sorted(loose, key=lambda s: -s * rng.uniform(0.8, 1.0))
    return best_fit(loose, capacity, list(child.items()), order)


def evolve(start: list[Solution], items: dict[int, int], capacity: int, seed: int, generations: int, population: int, target: int) -> list[Solution]:
    """Generations on one island; ends early at `target` bins, the least that can be."""
    rng = random.Random(seed)
    pool = list(start)
    while len(pool) < population:
        pool.append(best_fit(items, capacity, (), sorted(items, key=lambda s: -s * rng.uniform(0.7, 1.0))))
    for _ in range(generations):
        pool.sort(key=lambda s: fitness(s, capacity), reverse=True)
        del pool[population:]
        if bins(pool[0]) <= target:
            break
        for i in range(1, population):
            a, b = rng.sample(pool[:population], 2) if i > 1 else (pool[0], pool[i])
            pool.append(crossover(a, b, items, capacity, rng))
    pool.sort(key=lambda s: fitness(s, capacity), reverse=True)
    return pool[:population]


def pack(spark: SparkSession, items: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> Solution:
    """The best packing found of `items` (length -> how many).

    What moves between driver and islands is bounded by the capacity: at most some thousand patterns a solution.
    """
    items = {int(s): int(n) for s, n in items.items() if n}
    if not items:
        return []
    target = -(-sum(s * n for s, n in items.items()) // capacity)
    best = best_fit(items, capacity)
    if bins(best) <= target:
        return best
    pools: list[list[Solution]] = [[best] if i == 0 else [] for i in range(islands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for island, seed, pool in zip(*(batch.column(c).to_pylist() for c in ("island", "seed", "pool")), strict=True):
                start = [[(tuple(map(tuple, p)), m) for p, m in s] for s in json.loads(pool)]
                got = evolve(start, items, capacity, seed, generations, population, target)
                yield pa.RecordBatch.from_pydict({"island": [island], "pool": [json.dumps(got)]})

    for epoch in range(epochs):
        rows = [(i, epoch * islands + i, json.dumps(pools[i])) for i in range(islands)]
        frame = spark.createDataFrame(rows, "island long, seed long, pool string").repartition(islands, "island")
        for r in frame.mapInArrow(tidy(run), "island long, pool string").collect():
            pools[r.island] = [[(tuple(map(tuple, p)), m) for p, m in s] for s in json.loads(r.pool)]
        best = max((p[0] for p in pools if p), key=lambda s: fitness(s, capacity))
        if bins(best) <= target:
            break
        elite = [p[:ELITE] for p in pools]
        pools = [p + elite[i - 1] for i, p in enumerate(pools)]
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with the task that made it and its number among that task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = library_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, limit=ENCODE_BYTES):
            flat, at = encode(batch.column("text"))
            sizes = np.diff(at) + 1
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(batch.num_rows), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            grouped = length[order]
            first = np.searchsorted(grouped, grouped)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - first + seen[grouped]
            seen += np.bincount(length, minlength=capacity + 1)
            ids = np.insert(flat, at[1:], end_id)
            begin = at[row] + row + start
            crcs = [crc32_ids(ids[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crcs, pa.int64()), "part": pa.array(np.full(len(row), part)), "rank": pa.array(rank)}
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def place(rows: DataFrame, solution: Solution, capacity: int) -> DataFrame:
    """Give the `nth` piece of each length its sequence and offset in the packing."""
    per_size: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)  # first nth, sequence, offset, how many in a bin, copies
    taken, sequence = defaultdict(int), 0
    for pattern, copies in solution:
        offset = 0
        for size, k in pattern:
            per_size[size].append((taken[size], sequence, offset, k, copies))
            taken[size] += k * copies
            offset += size * k
        sequence += copies
    plan = {s: np.array(v, np.int64).T for s, v in per_size.items()}
    shared = rows.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, see best_fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            seq, off = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for idx in np.split(order, cuts) if len(order) else []:
                size = int(length[idx[0]])
                first, sequence, offset, k, _ = shared.value[size]
                at = np.searchsorted(first, nth[idx], side="right") - 1
                rest = nth[idx] - first[at]
                seq[idx] = sequence[at] + rest // k[at]
                off[idx] = offset[at] + rest % k[at] * size
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut what is longer than the capacity, pack.

    The tokenized pieces go to the shared folder once.  A piece's number among all of its length is its
    task's base plus its number in the task: sums over (length, task) rows, which split a hot length.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = cut(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    items = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    solution = pack(spark, items, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = rows.join(bases, (rows.length == bases.l) & (rows.part == bases.p)).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("nth"))
    return place(numbered, solution, capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids; a row per piece.

    A null or empty text is the end id alone, a piece of length 1. Repeated rows are packed as often as they
    occur. An empty table gives no row.
    """
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
