"""Hashed counts of byte n-grams and simple shapes for batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: n-grams that are hashed at once.
STEP = 1 << 19
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)  # odd multipliers, one for each place


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, where each starts; one more entry for the end). A null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def add_grams(X: np.ndarray, data: np.ndarray, ends: np.ndarray, n: int, bits: int, at: int) -> None:
    """Count the n-grams inside each text into the columns of X from `at` on; STEP of them at a time, so that a long text
    needs no more than a short one."""
    total, width = len(data) - n + 1, 1 << bits
    for a in range(0, max(0, total), STEP):
        b = min(total, a + STEP)
        h = data[a:b].astype(np.uint32) * _MIX[0]
        for k in range(1, n):
            h += data[a + k : b + k] * _MIX[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        low, high = (np.searchsorted(ends, [a, b - 1], side="right") - 1).tolist()
        cuts = np.clip(ends[low : high + 2], a, b)
        for row in range(low, high + 1) if high - low < 8 else ():
            own = h[cuts[row - low] - a : max(cuts[row - low], min(b, int(ends[row + 1]) - n + 1)) - a]
            X[row, at : at + width] += np.bincount(own >> np.uint32(32 - bits), minlength=width)
        if high - low >= 8:
            owner = np.repeat(np.arange(high - low + 1), np.diff(cuts))
            inside = np.arange(a + n, b + n) <= ends[low + 1 : high + 2][owner]
            flat = owner[inside] * width + (h >> np.uint32(32 - bits))[inside]
            X[low : high + 1, at : at + width] += np.bincount(flat, minlength=(high - low + 1) * width).reshape(-1, width)


def kept_sizes(keep: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are kept."""
    return np.array([np.count_nonzero(keep[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)


def shape_classes() -> np.ndarray:
    """For each byte: lower letter, upper letter, digit, space, newline, non-ASCII, or the ASCII sign itself."""
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    kind[128:] = 4
    return kind


_SHAPE = shape_classes()


def shapes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts as runs of classes, each run once."""
    kind = _SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[ends[:-1][ends[:-1] < len(kind)]] = True
    return kind[keep], np.concatenate([[0], np.cumsum(kept_sizes(keep, ends))])


def word_repeats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, distinct words) of each text."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = words.offsets.to_numpy()
    sizes = np.diff(ends)
    coded = words.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pairs = np.unique(owner * (len(coded.dictionary) + 1) + coded.indices.to_numpy())
    return sizes, np.bincount(pairs // (len(coded.dictionary) + 1), minlength=len(sizes))
