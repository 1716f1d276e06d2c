"""Token ids for batches of texts by way of a cache of white-space separated chunks.

Every rule of the supported tokenizers works inside a run of characters without
ASCII white space, so a text's ids are the ids of its chunks in a row.  A worker
therefore splits a whole batch in C++, dictionary-encodes the chunks and looks at
each distinct chunk once; words met before come from a cache of bounded size.
Where the file's rules are known, the distinct chunks of a batch go through them as one
text, and the library merges the new words of a part in one call.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Text bytes per dictionary-encoded slice: larger ones repeat fewer chunks.
ENCODE_BYTES = 8 << 20


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte.

    Printable Latin-1 characters stand for themselves; the others get code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordRules:
    """What a word-end BPE file does to a text before its merges: added tokens, NFC, lower case, the word pattern, byte letters.

    `supported` is false for a file with other steps.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)  # not kept: its vocabulary and merges are large
        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = [x["type"] for x in norm.get("normalizers", [])]
        splits = pre.get("pretokenizers", [])
        self.supported = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        if not self.supported:
            return
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.word, self.word_or_line = regex.compile(pattern), regex.compile(rf"{pattern}|\n")
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): letters[b] for b in range(128) if letters[b] != chr(b)})
        self.wide = str.maketrans({chr(b): letters[b] for b in range(256) if letters[b] != chr(b)})
        self.points = np.array([ord(x) for x in letters], "<u4")
        self.points[10] = 10

    def _newer(self, part: str) -> list[str]:
        """For characters younger than Python's tables: the library's own steps before its merges."""
        if not hasattr(self, "library"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk in byte letters; an added token comes as its id."""
        if chunk.isascii():
            if "<|" not in chunk or self.cut_added is None or not self.cut_added.search(chunk):
                low = chunk.lower()
                if low.isalpha():
                    return [low]
                words = self.word.findall(low)
                return words if low.isprintable() else [w.translate(self.letters) for w in words]  # a space isn't in a chunk
        out: list[str | int] = []
        for part in self.cut_added.split(chunk) if self.cut_added else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            elif any(unicodedata.category(c) == "Cn" for c in part):
                out += self._newer(part)
            elif part:
                low = "".join(map(str.lower, unicodedata.normalize("NFC", part)))  # each character by itself: no final sigma
                out += [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.wide) for w in self.word.findall(low)]
        return out

    def words_of_all(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
        """(distinct words, not in byte letters yet; the number of each word of all chunks in a row; how many each chunk has;
        chunks that are for `words` and have none here). The chunks are one text of a line each: no rule looks beyond a line's end."""
        text, odd = "\n".join(chunks), []
        young = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        if young or any(x in text for x in self.added):
            odd = [i for i, c in enumerate(chunks) if not young.isdisjoint(c) or any(x in c for x in self.added)]
            others = list(chunks)
            for i in odd:
                others[i] = ""
            text = "\n".join(others)
        low = "\u03c3".join(map(str.lower, unicodedata.normalize("NFC", text).split("\u03a3")))  # no final sigma
        coded = pa.array(["\n", *self.word_or_line.findall(low), "\n"], pa.large_string()).dictionary_encode()  # a line's end is number 0
        codes = coded.indices.to_numpy()
        ends = np.flatnonzero(codes == 0)
        return coded.dictionary[1:].to_numpy(zero_copy_only=False).tolist(), codes[codes > 0] - 1, np.diff(ends) - 1, odd

    def in_letters(self, words: list[str]) -> list[str]:
        """Words in byte letters."""
        data = np.frombuffer("\n".join(words).encode("utf-8"), np.uint8)
        return self.points[data].tobytes().decode("utf-32-le").split("\n") if words else []


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces of `flat` in a row, where each starts; one more entry for the end)."""
    after = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    kind = np.int32 if max(len(flat), after[-1]) < 1 << 31 else np.int64
    at = np.repeat((start - after[:-1]).astype(kind), size)
    at += np.arange(after[-1], dtype=kind)
    return flat[at], after


class WordEncoder:
    """Ids of texts by `merge`, which gives the ids of words in a row and how many each has.  The cache restarts after `limit` words or `chars` characters and ids."""

    PART = 50_000

    def __init__(self, rules: WordRules, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, chars: int = 6 << 20):
        self.rules, self.merge, self.limit, self.chars = rules, merge, limit, chars
        self._restart()

    def _restart(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the words stand in the cache, those that are new at its end."""
        if len(self.slot) > self.limit or self.held > self.chars:
            self._restart()
        new = [w for w in words if w not in self.slot]
        ids, sizes = self.merge(self.rules.in_letters(new))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, sizes])
        self.held += len(ids) + sum(map(len, new))
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks in a row, how many each has)."""
        words, codes, counts, odd = self.rules.words_of_all(chunks)
        slots = self._slots(words)[codes]
        ids, after = gathered(self.flat, self.start[slots], self.size[slots])
        at = after[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(at)
        if odd:
            own = [[x for w in self.rules.words(chunks[i]) for x in ([w] if isinstance(w, int) else self.merge([w])[0].tolist())] for i in odd]
            sizes[odd] = list(map(len, own))
            ids = np.insert(ids, np.repeat(at[odd], sizes[odd]), np.array([x for xs in own for x in xs], np.uint32))
        return ids, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text starts; one more entry for the end). A null text is empty."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = chunks.offsets.to_numpy()
        coded = chunks.flatten().dictionary_encode()
        parts = [self._ids(coded.dictionary.slice(a, self.PART).to_numpy(zero_copy_only=False).tolist()) for a in range(0, len(coded.dictionary), self.PART)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)])
        size = np.concatenate([np.zeros(0, np.int64), *(sizes for _, sizes in parts)])
        start, codes = np.cumsum(size) - size, coded.indices.to_numpy()
        ids, after = gathered(flat, start[codes], size[codes])
        return ids, after[ends - ends[0]]


class ChunkEncoder:
    """Ids of texts; `encode_many` gives the ids of distinct chunks.  The cache restarts after `limit` chunks or `chars` characters and ids."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], limit: int = 200_000, chars: int = 6 << 20):
        self.encode_many, self.limit, self.chars = encode_many, limit, chars
        self._restart()

    def _restart(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            got = self.encode_many(part)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            n, total = len(self.slot), int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) > len(self.start):
                self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.flat[self.used : self.used + total] = np.fromiter((x for ids in got for x in ids), np.uint32, total)
            self.start[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(part)] = sizes
            self.used += total
            self.held += total + sum(map(len, part))
            self.slot.update(zip(part, range(n, n + len(part)), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text starts; one more entry for the end). A null text is empty."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = chunks.offsets.to_numpy()
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) > self.limit or self.held > self.chars:
            self._restart()
        new = [w for w in words if w not in self.slot]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.size[slots]
        after = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        shift = self.start[slots] - after[:-1]
        ids = self.flat[np.repeat(shift, sizes) + np.arange(after[-1])]
        return ids, after[ends - ends[0]]


def by_words(rules: WordRules, encode_words: Callable[[list[str]], list[list[int]]], limit: int = 150_000, chars: int = 3 << 20) -> Callable[[list[str]], list[list[int]]]:
    """Chunk ids from word ids, with a cache of words that restarts after `limit` words or `chars` characters."""
    known: dict[str, list[int]] = {}
    held = 0

    def encode_many(chunks: list[str]) -> list[list[int]]:
        nonlocal held
        if len(known) > limit or held > chars:
            known.clear()
            held = 0
        split = [rules.words(c) for c in chunks]
        new = list({w for ws in split for w in ws if w.__class__ is str and w not in known})
        held += sum(map(len, new))
        known.update(zip(new, encode_words(new), strict=True))
        return [known[ws[0]] if len(ws) == 1 and ws[0].__class__ is str else [x for w in ws for x in (known[w] if w.__class__ is str else (w,))] for ws in split]

    return encode_many


def merged_by(tok) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """(ids of words in byte letters in a row, how many each has), by the model of a tokenizer of the library.

    Some words are one call; which id ends a word is told by the model's suffix. Where that doesn't hold, words go one by one.
    """
    from tokenizers import Tokenizer

    model, bare = tok.model, Tokenizer(tok.model)
    suffix = model.end_of_word_suffix
    vocabulary = bare.get_vocab()
    closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    closing[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
    del vocabulary

    def merge(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            got = np.array(bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(closing[got]) + 1
            if len(ends) != len(part) or ends[-1] != len(got):
                each = [[t.id for t in model.tokenize(w)] for w in part]
                got, ends = np.array([x for xs in each for x in xs], np.uint32), np.cumsum(list(map(len, each)))
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    return merge


_MADE: dict[str, WordEncoder | ChunkEncoder] = {}


def library_encoder(path: str) -> WordEncoder | ChunkEncoder:
    """One encoder a worker, which later tasks find with its caches, for a file of the tokenizers library, without special tokens, truncation and padding.

    The library's own model merges the distinct words; a file whose normalizer or word pattern
    is not one of those that WordRules knows goes through the library's encode for each chunk.
    """
    if path not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, rules = Tokenizer.from_file(path), WordRules(path)
        tok.no_truncation()
        tok.no_padding()
        if rules.supported:
            _MADE[path] = WordEncoder(rules, merged_by(tok))
        else:
            _MADE[path] = ChunkEncoder(lambda chunks: [e.ids for e in tok.encode_batch_fast(chunks, add_special_tokens=False)])
    return _MADE[path]
