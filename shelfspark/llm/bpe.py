"""Operator 6: byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree are its adjacent symbol pairs, each with the key
(rank, position); an inner node is the smaller of its children, so that the root
is the leftmost pair of the lowest rank.  A merge changes three leaves: the pair
itself, the one to its left and the one that its right symbol began; each change
climbs one path.  The word is done when the root holds no mergeable pair.
Words of the same tree size are merged side by side in numpy; long words alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy
from .tokens import ENCODE_BYTES, ChunkEncoder, WordRules, by_words, tokenizer_path

_NONE = np.int64(1 << 62)
_AT = np.int64((1 << 32) - 1)
#: Words with more symbols are merged one at a time.
SIDE_BY_SIDE = 64


class SegmentTreeBPE:
    """Merges of a word-end BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        into = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.base = np.int64(max(self.vocab.values()) + 2)
        keys = left * self.base + right
        _, first = np.unique(keys[::-1], return_index=True)  # of a repeated pair the last rank counts
        order = len(keys) - 1 - first
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into[order]
        self.by_pair = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, into, strict=True))}
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}

    def symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]] if word else []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters."""
        out: list[list[int]] = [self.symbols(w) for w in words]
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(out):
            if len(s) > SIDE_BY_SIDE:
                out[i] = self.one(s)
            elif len(s) > 1:
                groups.setdefault(1 << (len(s) - 2).bit_length() if len(s) > 2 else 1, []).append(i)
        for leaves, members in groups.items():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                for i, ids in zip(part, self.side_by_side([out[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf key of each pair; a missing symbol is -1."""
        pair = left * self.base + right
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[k] == pair) & (left >= 0) & (right >= 0), self.ranks[k] << 32 | at, _NONE)

    def side_by_side(self, words: list[list[int]], leaves: int) -> list[list[int]]:
        n, width = len(words), leaves + 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        sym = np.full((n, width + 1), -1, np.int64)  # the last column stays empty: what missing neighbours point to
        sym[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(k) for k in sizes])] = [x for w in words for x in w]
        nxt = np.minimum(np.tile(np.arange(1, width + 2), (n, 1)), width)
        prv = np.tile(np.arange(-1, width), (n, 1))
        prv[:, 0] = width
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = self._keys(sym[:, :leaves], sym[:, 1 : leaves + 1], np.arange(leaves, dtype=np.int64))
        for k in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        while len(rows := np.flatnonzero(tree[:, 1] < _NONE)):
            key = tree[rows, 1]
            at, k = key & _AT, key >> 32
            right = nxt[rows, at]
            after, before = nxt[rows, right], prv[rows, at]
            sym[rows, at] = self.into_of_rank(k)
            sym[rows, right] = -1
            nxt[rows, at] = after
            prv[rows, after] = at
            changes = [(at, self._keys(sym[rows, at], sym[rows, after], at)), (before, self._keys(sym[rows, before], sym[rows, at], before)), (right, np.full(len(rows), _NONE))]
            for leaf, value in changes:
                inside = leaf < leaves
                r, node = rows[inside], leaf[inside] + leaves
                tree[r, node] = value[inside]
                for _ in range(leaves.bit_length() - 1):
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        kept = sym >= 0
        flat, ends = sym[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def into_of_rank(self, rank: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_by_rank"):
            self._by_rank = np.zeros(int(self.ranks.max()) + 1, np.int64)
            self._by_rank[self.ranks] = self.into
        return self._by_rank[rank]

    def one(self, sym: list[int]) -> list[int]:
        """The same for a single long word, in O(log n) steps a merge."""
        n = len(sym)
        leaves = 1 << (n - 2).bit_length()
        none, sym = int(_NONE), list(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            if got := self.by_pair.get((sym[i], sym[i + 1])):
                tree[leaves + i] = got[0] << 32 | i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = leaf + leaves
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        def key(i: int, j: int) -> int:
            got = self.by_pair.get((sym[i], sym[j]))
            return got[0] << 32 | i if got else none

        while tree[1] < none:
            at = tree[1] & int(_AT)
            right = nxt[at]
            sym[at] = self.by_pair[sym[at], sym[right]][1]
            after = nxt[at] = nxt[right]
            sym[right] = -1
            if right < leaves:  # the last symbol begins no pair
                put(right, none)
            if after < n:
                prv[after] = at
            put(at, key(at, after) if after < n else none)
            if prv[at] >= 0:
                put(prv[at], key(prv[at], at))
        return [x for x in sym if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """As a file without decoder asks for: the tokens with spaces between, special ones as well; unknown ids give nothing."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_MADE: dict[str, tuple[SegmentTreeBPE, ChunkEncoder]] = {}


def segment_tree_encoder(path: str) -> tuple[SegmentTreeBPE, ChunkEncoder]:
    """One encoder a worker."""
    if path not in _MADE:
        rules = WordRules(path)
        if not rules.supported:
            raise ValueError(f"{path}: only word-end BPE files with NFC, lower case and a word pattern are supported")
        bpe = SegmentTreeBPE(path)
        _MADE[path] = bpe, ChunkEncoder(by_words(rules, bpe.encode_words))
    return _MADE[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = segment_tree_encoder(tokenizer)
        sha = hashlib.sha256
        for batch in slices(batches, limit=ENCODE_BYTES):
            flat, at = encode(batch.column("text"))
            raw, n = flat.astype("<u4"), batch.num_rows
            parts = [raw[at[i] : at[i + 1]] for i in range(n)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": [sha(p.tobytes()).hexdigest() for p in parts],
                    "decoded_sha256": [sha(bpe.decode(p.tolist()).encode("utf-8")).hexdigest() for p in parts],
                }
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; one row per row of `documents`, repeated rows included.

    Null and empty texts have no ids and decode to the empty string; the work is one pass without a shuffle.
    """
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
