"""Hashes of words, worked out for many at once, are the library's."""

import random

import numpy as np
import pytest
import xxhash

from shelfspark.llm import shingles


@pytest.mark.parametrize("seed", range(4))
def test_word_hashes_are_those_of_the_library(seed):
    rng = random.Random(seed)
    letters = [b for b in range(256) if b not in (32, *range(9, 14))]
    words = [bytes(rng.choices(letters, k=n)) for n in [*range(1, 40), 100, 5000] for _ in range(20)] + [b"A", b"Zz", b"@[`{", b"\x00", b"\x00\x00\x00\x00"]
    rng.shuffle(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    expected = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.lower()) for w in words), np.uint64).reshape(-1, 2).T
    for lanes in (1, 2):
        assert (shingles.word_hashes(data, start, end, lanes) == expected[:lanes]).all()
        found = shingles.words_of(data, np.array([0, len(data)]), lanes)
        assert (found.hashes == expected[:lanes]).all() and (found.start == start).all()


def test_short_words_do_not_go_to_the_library(monkeypatch):
    asked = []
    real = xxhash.xxh3_128_digest
    monkeypatch.setattr(shingles.xxhash, "xxh3_128_digest", lambda w: (asked.append(w), real(w))[1])
    data = np.frombuffer(b"The quick brown fox " * 3 + b"antidisestablishmentarianism " * 2, np.uint8)
    shingles.words_of(data, np.array([0, len(data)]))
    assert asked == [b"antidisestablishmentarianism"]


def test_no_words():
    assert shingles.words_of(np.zeros(0, np.uint8), np.array([0, 0])).hashes.shape == (2, 0)
    assert shingles.words_of(np.frombuffer(b" \n", np.uint8), np.array([0, 1, 2])).hashes.shape == (2, 0)
