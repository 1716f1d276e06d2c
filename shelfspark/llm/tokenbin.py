"""Operator 5: token ids of a corpus in binary shards with Elias-Fano document boundaries.

A shard is ``EFTOKENS``, a fixed head, the ids of its documents in a row (two bytes
each where the vocabulary allows it, else four) and, behind them, two Elias-Fano
sequences: the document ids and the boundaries.  The head tells where those start,
so that a reader fetches them and then any document's ids by one ranged read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_ids, cut, filesystem, join_uri, put_file, scratch, slices, table, tidy
from .eliasfano import EliasFano
from .tokens import ENCODE_BYTES, library_encoder, tokenizer_path

MAGIC = b"EFTOKENS"
#: magic, version, id bytes, documents, documents without id (they come first), ids, where the sequences start
HEAD = struct.Struct("<8sHHQQQQ")
#: A shard is closed at the first document that takes it beyond so many ids, and after so many documents.
SHARD_IDS, SHARD_DOCS = 1 << 24, 1 << 18
#: Documents whose offsets are selected at once, and ids that are read at once (a longer document stands alone).
READ_DOCS, READ_IDS = 2000, 1 << 20
END_ID = 1


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: list[np.ndarray], width: int) -> Iterator[bytes]:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    yield HEAD.pack(MAGIC, 1, width, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), HEAD.size + width * int(ends[-1]))
    for part in ids:
        yield part.astype(f"<u{width}").tobytes()
    yield EliasFano.encode(known).to_bytes()
    yield EliasFano.encode(ends).to_bytes()


class Shard:
    """A shard opened for reading: document ids, boundaries and ranged reads of ids."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic, version, self.width, self.n, nulls, self.n_ids, at = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{uri} isn't a shard of token ids")
        tail = self.file.read_at(self.file.size() - at, at)
        self.known, end = EliasFano.from_bytes(tail)
        self.bounds, end = EliasFano.from_bytes(tail, end)
        self.nulls = nulls
        if end != len(tail) or self.known.n + nulls != self.n or self.bounds.n != self.n + 1 or self.bounds.select(self.n) != self.n_ids:
            raise ValueError(f"{uri} is damaged")

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """The document ids i..j-1; those without one come first."""
        a, b = max(i, self.nulls), max(j, self.nulls)
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + (self.known.select_range(a - self.nulls, b - self.nulls).tolist() if b > a else [])

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from `start` up to `end`."""
        got = self.file.read_at((end - start) * self.width, HEAD.size + start * self.width)
        return np.frombuffer(got, f"<u{self.width}").astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by selection in the boundaries."""
        return self.read(self.bounds.select(i), self.bounds.select(i + 1))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Write `docs` (doc_id, text) in ascending doc_id order; returns the manifest: a row per shard with its part, number
    in the part, path, documents, ids and bytes, in the shared folder.

    Rows with the same doc_id follow a hash of their text; equal rows follow their place in the table, so that a pair of
    doc_id and text that many rows share is split like any other range.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, k = task.partitionId(), str(task.taskAttemptId()), 0
        encode = library_encoder(tokenizer)
        doc_ids, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k, doc_ids, sizes, ids, held
            # an end id above 16 bits needs the wide form as well
            width = 2 if max([int(x.max(initial=0)) for x in ids], default=0) < 1 << 16 else 4
            name = f"shard-{part:06d}-{k:05d}.eft"
            n_bytes = put_file(folder, name, shard_bytes(doc_ids, np.array(sizes), ids, width), attempt)
            row = pa.RecordBatch.from_pydict({"part": [part], "k": [k], "path": [join_uri(folder, name)], "n_docs": [len(doc_ids)], "n_ids": [held], "n_bytes": [n_bytes]})
            doc_ids, sizes, ids, held, k = [], [], [], 0, k + 1
            return row

        for batch in slices(batches, limit=ENCODE_BYTES):
            flat, at = encode(batch.column("text"))
            whole = np.insert(flat, at[1:], end_id)
            ends = at[1:] + np.arange(1, len(at))
            names, first = batch.column("doc_id").to_pylist(), 0
            while first < len(names):
                base = int(ends[first - 1]) if first else 0
                to = min(len(names), first + shard_docs - len(doc_ids), int(np.searchsorted(ends, base + shard_ids - held)) + 1)
                doc_ids += names[first:to]
                sizes += np.diff(ends[first:to], prepend=base).tolist()
                part_ids = whole[base : int(ends[to - 1])]
                ids.append(part_ids.astype(np.uint16) if part_ids.max(initial=0) < 1 << 16 else part_ids)
                held += int(ends[to - 1]) - base
                first = to
                if held >= shard_ids or len(doc_ids) >= shard_docs:
                    yield flush()
        if doc_ids:
            yield flush()

    keys = ["doc_id", "tie", "place"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return cut(ordered.mapInArrow(tidy(write), "part long, k long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row per document read back: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32, shard.

    Boundaries and document ids are selected some at a time; no table of them is ever whole in memory.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("earlier"))  # a row per task of the writing
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("k")) - F.col("n_ids")
    files = shards.withColumn("inner", inner).join(earlier, "part").select("path", (F.col("inner") + F.col("earlier")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(path)
                for a in range(0, shard.n, READ_DOCS):
                    b = min(a + READ_DOCS, shard.n)
                    ends = shard.bounds.select_range(a, b + 1)
                    crcs, lo = [], 0
                    while lo < b - a:
                        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + READ_IDS, side="right")) - 1)
                        ids = shard.read(int(ends[lo]), int(ends[hi]))
                        crcs += [crc32_ids(ids[ends[i] - ends[lo] : ends[i + 1] - ends[lo]]) for i in range(lo, hi)]
                        lo = hi
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(a, b), pa.int64()), "start": pa.array(start + ends[:-1]), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([path.rsplit("/", 1)[1]] * (b - a))})

    return files.repartition(max(1, min(shards.count(), 4096))).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write Elias-Fano shards, read them back.

    A null text is empty and gets the end id only; a null doc_id sorts first; documents with the same
    doc_id are all kept, in the order of a hash of their text; an empty table gives no shard and no row. Further
    columns take no part. Memory: a shard's ids, and about 20 bytes for each of a text's.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, scratch(spark, "tokens"), tokenizer_path("word_bpe_49k.json")))
