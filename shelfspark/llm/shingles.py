"""Words and word shingles of batches of texts as hashes.

A word's hash is XXH3 of its bytes: those of up to 16 bytes are worked out for a window of text at once, longer ones by
the library, once for each distinct word of a window.
Runs of words are hashed by rounds of multiplication and mixing, so that no sequence of
words meets another by construction, as in a polynomial it would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .grams import joined

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text whose words are taken at once; a window ends at white space.
WINDOW = 1 << 21
#: Of XXH3, see xxhash.h: its secret's first words, folded, and its primes.
_SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), np.uint64)
_FLIP_1TO3 = np.uint64((int(_SECRET[1]) ^ int(_SECRET[1]) >> 32) & 0xFFFFFFFF), np.uint64((int(_SECRET[0]) ^ int(_SECRET[0]) >> 32) & 0xFFFFFFFF)
_FLIP_4TO8, _FLIP_9TO16 = _SECRET[2] ^ _SECRET[3], (_SECRET[4] ^ _SECRET[5], _SECRET[6] ^ _SECRET[7])
_PRIME_1, _PRIME_2, _PRIME_3, _PRIME_MIX, _PRIME_LAST = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0x165667919E3779F9))
_HALF = np.uint64(0xFFFFFFFF)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stir(h: np.ndarray) -> np.ndarray:
    """Mix in place what the next multiplication spreads further."""
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """The words of a batch of texts: runs without space, \\t, \\n, \\v, \\f, \\r; A-Z count as a-z.

    `hashes` has one or two independent rows of 64 bits; `at` where each text's words start, and the end; `start` and `end`
    the bytes of each word in all texts' bytes.
    """

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _windows(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that cut no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + WINDOW)
        while b < n and not _SPACE[data[b]]:  # on to the next white space or the next text
            step = np.flatnonzero(_SPACE[data[b : b + 4096]])
            text = int(ends[np.searchsorted(ends, b)])
            b = min(text, b + (int(step[0]) if len(step) else 4096))
            if b == text:
                break
        yield a, b
        a = b


def _product(a: np.ndarray, b: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) 64 bits of products of 64-bit numbers."""
    x, y, z, w = a & _HALF, a >> np.uint64(32), b & _HALF, b >> np.uint64(32)
    low, across = x * z, y * z
    across += low >> np.uint64(32)
    other = x * w
    other += across & _HALF
    high = y * w
    high += across >> np.uint64(32)
    high += other >> np.uint64(32)
    return a * b, high


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(37))) * _PRIME_LAST
    return h ^ (h >> np.uint64(32))


def _avalanche_of_few(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _PRIME_2
    h = (h ^ (h >> np.uint64(29))) * _PRIME_3
    return h ^ (h >> np.uint64(32))


def word_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 2) -> np.ndarray:
    """XXH3, 128 bits, of words given by their first byte and the byte after their last, A-Z as a-z; the first `lanes` rows of 64 bits."""
    low = np.zeros(len(part) + 8, np.uint8)
    low[: len(part)] = part | ((part - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    size, out = end - start, np.empty((2, len(start)), np.uint64)
    at = lambda where, n: np.lib.stride_tricks.as_strided(low, (len(low) - n + 1, n), (1, 1))[where].view(f"<u{n}").ravel()

    own = np.flatnonzero(size <= 3)
    s, n = start[own], size[own]
    c = low[s].astype(np.uint32) << 16 | low[s + (n >> 1)].astype(np.uint32) << 24 | low[s + n - 1] | n.astype(np.uint32) << 8
    turned = c.byteswap()
    turned = turned << 13 | turned >> 19
    out[0, own], out[1, own] = _avalanche_of_few(turned ^ _FLIP_1TO3[0]), _avalanche_of_few(c ^ _FLIP_1TO3[1])

    own = np.flatnonzero((size > 3) & (size <= 8))
    s, n = start[own], size[own]
    first, high = _product((at(s, 4) | at(s + n - 4, 4).astype(np.uint64) << np.uint64(32)) ^ _FLIP_4TO8, _PRIME_1 + (n.astype(np.uint64) << np.uint64(2)))
    high += first << np.uint64(1)
    out[0, own] = _avalanche(high)
    if lanes > 1:
        first ^= high >> np.uint64(3)
        first = (first ^ (first >> np.uint64(35))) * _PRIME_MIX
        out[1, own] = first ^ (first >> np.uint64(28))

    own = np.flatnonzero((size > 8) & (size <= 16))
    s, n = start[own], size[own]
    last = at(s + n - 8, 8)
    first, high = _product(at(s, 8) ^ last ^ _FLIP_9TO16[0], _PRIME_1)
    first += (n - 1).astype(np.uint64) << np.uint64(54)
    last ^= _FLIP_9TO16[1]
    high += last + (last & _HALF) * np.uint64(0x85EBCA76)
    first ^= high.byteswap()
    first, more = _product(first, _PRIME_2)
    out[0, own], out[1, own] = _avalanche(more + high * _PRIME_2), _avalanche(first)
    out = out[:lanes].byteswap()  # as in the library's digest

    own = np.flatnonzero(size > 16)
    if len(own):
        offsets = np.zeros(len(own) + 1, np.int32)
        np.cumsum(size[own], out=offsets[1:])
        marks = np.zeros(len(part) + 1, np.int8)
        marks[start[own]] += 1
        marks[end[own]] -= 1
        coded = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(low[: len(part)][np.cumsum(marks[:-1], dtype=np.int8).view(bool)])]).dictionary_encode()
        known = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
        out[:, own] = np.frombuffer(known, np.uint64).reshape(-1, 2).T[:lanes, coded.indices.to_numpy()]
    return out


def words_of(data: np.ndarray, ends: np.ndarray, lanes: int = 2) -> Words:
    """The words of texts given as their bytes in a row and where each starts; the first `lanes` rows of their hashes."""
    hashes, starts, stops = [], [], []
    for a, b in _windows(data, ends):
        part = data[a:b]
        space = _SPACE[part]
        edge = ends[slice(*np.searchsorted(ends, [a, b], side="right"))] - a
        edge = edge[edge < b - a]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        first[edge] = ~space[edge]
        last[:-1] &= space[1:]
        last[edge - 1] = ~space[edge - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        starts.append(s + a)
        stops.append(e + a)
        if lanes:
            hashes.append(word_hashes(part, s, e, lanes))
    none = np.zeros(0, np.int64)
    start, end = np.concatenate([none, *starts]), np.concatenate([none, *stops])
    return Words(np.concatenate([np.zeros((lanes, 0), np.uint64), *hashes], axis=1), np.searchsorted(start, ends), start, end)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= _ODD[0]
        h += words[i : i + n]
        stir(h)
    return mix(h * _ODD[1])


def range_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the words a..b of each of some ranges: of the two longest runs of 2^j words that start and end it, and its size.

    Runs of 2^(j+1) words come from those of 2^j words, level by level, so that memory holds two levels.
    """
    out = np.zeros(len(a), np.uint64)
    level = np.frexp(np.maximum(b - a, 1))[1] - 1  # 2^level <= size
    runs = words
    most = int(level.max(initial=-1))
    for j in range(most + 1):
        own = np.flatnonzero(level == j)
        size = (b[own] - a[own]).astype(np.uint64)
        out[own] = mix(runs[a[own]] * _ODD[0] + runs[b[own] - (1 << j)] * _ODD[1] + size)
        if j < most:
            longer = runs[: -(1 << j)] * _ODD[0]
            longer += runs[1 << j :]
            runs = stir(longer)
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words the whole as one; of none nothing."""
    words = words_of(*joined(texts), lanes=1)
    own, at = words.hashes[0], words.at
    runs = run_hashes(own, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            h = np.sort(runs[a : b - k + 1])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif b > a:
            yield run_hashes(own[a:b], b - a) ^ np.uint64((b - a) * 0x9E3779B9)
        else:
            yield runs[:0]
