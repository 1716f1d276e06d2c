"""Operators 5, 6 and 9: ids, shards and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import bpe, packing, tokenbin
from shelfspark.llm.common import scratch, table
from shelfspark.llm.eliasfano import EliasFano
from shelfspark.llm.tokens import library_encoder, tokenizer_path

from .conftest import DOCS, doc, prose

WORD_BPE = tokenizer_path("word_bpe_49k.json")
ODD = ["", None, "  lead  trail \n", "ΑΣ ΣΑΣ. ǅ İx <|endoftext|>foo<|startoftext|> it's don't 12 3a", "\x1c\x1d a\x85b ﬁ Å  x　y 한국어 👍🏽 é ́x", "abcde" * 5000, "aaaa" * 100, "''s'S don'T we'LLs ½ ² ٣٤", "a\tb\x0bc", "Same text.", "Same text."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids, lambda ids: tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("encoder", [library_encoder(WORD_BPE), bpe.segment_tree_encoder(WORD_BPE)[1]], ids=["library", "segment tree"])
def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(3)
    texts = [*ODD, prose(1, 500), "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(3000)), "".join(chr(rng.randrange(0xE000, 0x1FFFF)) for _ in range(3000))]
    ids, at = encoder(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library[0](t), i


def test_cache_restarts_without_changing_ids(library):
    from shelfspark.llm.tokens import ChunkEncoder

    encoder = ChunkEncoder(lambda words: [library[0](w) for w in words], limit=5)
    for seed in range(4):
        text = prose(seed, 40)
        assert encoder(pa.array([text]))[0].tolist() == library[0](text)


def test_words_are_merged_together(library):
    """Distinct words of a batch go to the library some thousand a call, whatever chunks and texts they stand in."""
    from shelfspark.llm.tokens import WordEncoder, WordRules, library_encoder

    merge, calls = library_encoder(WORD_BPE).merge, []

    def counted(words):
        calls.append(len(words))
        return merge(words)

    encoder = WordEncoder(WordRules(WORD_BPE), counted)
    texts = [*ODD, *(f"w{chr(97 + i % 26)}{i}x, Éé{i}ß. Σ{i}ΑΣ\u0378<|endoftext|>{i}" if i % 50 == 0 else f"Wörd{chr(97 + i % 26) * (i % 9)}, it's{i}" for i in range(1500))]
    for _ in range(2):  # the second time all words are known
        ids, at = encoder(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library[0](t), i
    assert sum(x > 1 for x in calls) == 1 and max(calls) > 100
    assert isinstance(library_encoder(WORD_BPE), WordEncoder)  # what the shards and the packing take
    small = WordEncoder(WordRules(WORD_BPE), merge, limit=3)
    small.PART = 4
    ids, at = small(pa.array(texts[:200], pa.string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(200)] == [library[0](t) for t in texts[:200]]
    assert [x.tolist() for x in encoder(pa.array([], pa.string()))] == [[], [0]]


def test_segment_tree_long_words_and_decoding(library):
    model = bpe.SegmentTreeBPE(WORD_BPE)
    rng = random.Random(5)
    for n in (1, 2, 3, 63, 64, 65, 66, 300):
        w = "".join(rng.choices("abcdefgh", k=n))
        assert model.encode_words([w]) == [library[0](w)]
        assert model.one(model.symbols(w)) == library[0](w) or n < 2
    ids = library[0]("Hello, wörld! <|endoftext|>")
    assert model.decode(ids) == library[1](ids)
    assert model.decode([10**9]) == library[1]([10**9]) == ""


@pytest.mark.parametrize("size,top", [(0, 1), (1, 5), (3, 0), (1000, 10), (1000, 1 << 40), (700, 1 << 62)])
def test_elias_fano(size, top):
    rng = np.random.default_rng(size + top % 97)
    values = np.sort(rng.integers(-top, top + 1, size))
    made = EliasFano.encode(values)
    read, end = EliasFano.from_bytes(b"xyz" + made.to_bytes(), 3)
    assert end == 3 + len(made.to_bytes()) and list(read.all()) == values.tolist()
    assert [read.select(i) for i in range(0, size, 7)] == values[::7].tolist()
    for i, j in [(0, size), (5, 6), (250, 260), (255, 512), (256, 257), (size - 1, size)]:
        if 0 <= i < j <= size:
            assert read.select_range(i, j).tolist() == values[i:j].tolist()
    with pytest.raises(IndexError):
        read.select(size)
    if size > 5:
        with pytest.raises(ValueError):
            EliasFano.from_bytes(made.to_bytes()[:-5])
        with pytest.raises(ValueError):
            EliasFano.encode(values[::-1] + np.arange(size)[::-1])


def docs_table(tables, rows):
    return tables(documents=(rows, DOCS + ", extra int" if False else DOCS))


def test_shards_round_trip(spark, tables, library):
    rows = [doc(7 * i % 101, t) for i, t in enumerate([*ODD, *(prose(k, 60) for k in range(60))])] + [doc(None, "no id"), doc(5, "twice"), doc(5, "twice"), doc(-3, "negative")]
    d = tables(documents=(rows, DOCS))
    shards = tokenbin.write_shards(table(spark, d, "documents").select("doc_id", "text"), scratch(spark, "t"), WORD_BPE, shard_ids=500, shard_docs=20)
    manifest = sorted(shards.collect(), key=lambda r: (r.part, r.k))
    assert len(manifest) > 3 and sum(s.n_docs for s in manifest) == len(rows) and max(s.n_docs for s in manifest) <= 20
    got = tokenbin.read_shards(shards).collect()
    assert len(got) == len(rows)
    sums = defaultdict(list)
    for i, t, *_ in rows:
        ids = np.array(library[0](t) + [1], "<u4")
        sums[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in sums[r.doc_id]
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    shard = tokenbin.Shard(manifest[0].path)
    assert shard.width == 2 and shard.document(0).tolist() == library[0]("no id") + [1]


def test_one_id_of_many_rows_and_empty_texts(spark, tables):
    d = tables(documents=([doc(5, "the same text")] * 20_000 + [doc(i, "") for i in range(10**12, 10**12 + 3 * 10**9, 10**5)], DOCS))
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these partitions are small
    try:
        shards = tokenbin.write_shards(docs, scratch(spark, "t"), WORD_BPE, shard_docs=4096)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.groupBy("part").sum("n_docs").agg({"sum(n_docs)": "max"}).first()[0] < 30_000  # equal rows go to several tasks
    got = tokenbin.read_shards(shards).selectExpr("count(*) n", "count(distinct start) starts", "max(start + n_tokens) ids", "sum(n_tokens) total", "count_if(n_tokens = 1) empty").first()
    assert got.n == got.starts == 50_000 and got.ids == got.total and got.empty == 30_000


def test_shards_of_an_empty_table(spark, tables):
    d = tables(documents=([], DOCS))
    assert tokenbin.op5_token_binary(spark, d).count() == 0
    assert bpe.op6_bpe_segment_tree(spark, d).count() == 0
    assert packing.op9_best_fit_packing(spark, d).count() == 0


def test_bpe_query(spark, tables, library):
    rows = [doc(i, t) for i, t in enumerate([*ODD, prose(9, 300)])]
    got = {r.doc_id: r for r in bpe.op6_bpe_segment_tree(spark, tables(documents=(rows, DOCS))).collect()}
    for i, t, *_ in rows:
        ids = library[0](t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library[1](ids).encode()).hexdigest()


def check_packing(rows, got, library, capacity):
    want = sum(-(-(len(library[0](t)) + 1) // capacity) for _, t, *_ in rows)
    assert len(got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= capacity and r.start == r.piece * capacity
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, tables, library):
    rows = [doc(i, t) for i, t in enumerate([*ODD, *(prose(k, 30 + 40 * (k % 9)) for k in range(80)), prose(99, 6000)])] + [doc(0, ""), doc(None, "x")]
    got = packing.op9_best_fit_packing(spark, tables(documents=(rows, DOCS))).collect()
    n = check_packing(rows, got, library, 2048)
    total = sum(len(library[0](t)) + 1 for _, t, *_ in rows)
    assert -(-total // 2048) <= n <= -(-total // 2048) + 1
    ids = {i: library[0](t) + [0] for i, t, *_ in rows if i not in (0, None)}
    for r in got:
        if r.doc_id in ids:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_crossover_keep_every_item(seed):
    rng = random.Random(seed)
    items = defaultdict(int)
    for _ in range(rng.choice([1, 7, 300, 5000])):
        items[rng.randint(1, 100)] += 1
    whole = lambda s: {k: n for k, n in count(s).items() if n}

    def count(solution):
        out = defaultdict(int)
        for p, m in solution:
            assert m > 0 and packing.fill(p) <= 100
            for size, k in p:
                out[size] += k * m
        return out

    a = packing.best_fit(items, 100)
    b = packing.best_fit(items, 100, (), sorted(items, key=lambda s: rng.random()))
    assert whole(a) == whole(b) == dict(items)
    for _ in range(5):
        assert whole(packing.crossover(a, b, items, 100, rng)) == dict(items)
    best = packing.evolve([b], items, 100, seed, 5, 4, 0)[0]
    assert whole(best) == dict(items) and packing.bins(best) <= packing.bins(b)


def test_genetic_search_beats_best_fit_where_it_can(spark):
    # six full bins, cut at random; best fit needs seven
    items = {36: 1, 38: 1, 14: 2, 12: 1, 44: 2, 43: 1, 13: 1, 31: 3, 42: 1, 27: 1, 25: 1, 30: 1, 20: 1, 18: 2, 32: 1, 21: 1, 16: 1}
    best = packing.pack(spark, items, 100, epochs=4, generations=20, population=8)
    assert packing.bins(best) == 6 < packing.bins(packing.best_fit(items, 100)) == 7
    assert packing.pack(spark, {}, 100) == []
