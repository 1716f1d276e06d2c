"""What is exchanged in buckets of many hashes a row, and what is not exchanged at all."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import ngram_join, sentence_spans
from shelfspark.llm.common import cut, table
from shelfspark.llm.shingles import shingle_sets

from .conftest import DOCS, doc, prose
from .test_passes import near_copies


@pytest.mark.parametrize(("buckets", "held"), [(1, 1 << 20), (7, 1), (64, 4096)])
def test_blocks_hold_every_pair_of_prefix_hashes(spark, tables, monkeypatch, buckets, held):
    rows = [*near_copies(), *near_copies(8), doc(None, prose(1, 80)), doc(99, None), doc(98, "one two"), doc(97, "One  two")]
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    names = ngram_join.Names(ngram_join.set_facts(docs, 5))
    expected = defaultdict(set)
    for r in docs.select("text").collect():
        (s,) = shingle_sets(pa.array([r.text], pa.string()))
        for h in s[: len(s) - -(-3 * len(s) // 4) + 1] if len(s) else ():
            expected[int(np.uint64(h).astype(np.int64))].add(names.of(s))
    monkeypatch.setattr(ngram_join, "HELD_BYTES", held)
    got = ngram_join.blocks(ngram_join.prefix_entries(docs, 5, names, buckets)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == {(h, min(sids), sid) for h, sids in expected.items() if len(sids) > 1 for sid in sids}


def test_prefix_hashes_are_exchanged_some_a_row(spark, tables):
    docs = table(spark, tables(documents=(near_copies(), DOCS)), "documents").coalesce(1)
    names = ngram_join.Names(ngram_join.set_facts(docs, 5))
    entries = ngram_join.prefix_entries(docs, 5, names, 4)
    assert entries.count() == 4  # before, a row for each hash


def wanted(spark, docs):
    names = ngram_join.Names(ngram_join.set_facts(docs, 5))
    facts = ngram_join.set_facts(docs, 5).select("doc_id", "n_shingles", names.column().alias("sid"), "sig").where("sid is not null")
    sigs = cut(facts.groupBy("sid").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id"), "sigs")
    return names, sigs, cut(sigs.where("doc_id % 3 = 0 or doc_id is null").select("sid"), "wanted")


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_sets_come_whole_whether_doc_ids_or_texts_move(spark, tables, monkeypatch, most):
    rows = [*near_copies(), doc(None, prose(900, 80)), doc(3, prose(901, 30)), doc(3, prose(3, 80)), doc(70, "")]
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    names, sigs, some = wanted(spark, docs)
    monkeypatch.setattr(ngram_join, "MOST_OWNERS", most)
    plans, real = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    got = {r.sid: bytes(r.hashes) for r in ngram_join.stored_sets(docs, some, sigs, 5, names).collect()}
    assert set(got) == {r.sid for r in some.collect()}
    assert all(names.of(np.frombuffer(h, np.uint64)) == sid for sid, h in got.items())
    assert ("strategy=broadcast" in dict(plans)["sets"]) == (most > 0)  # before, all texts were exchanged


def test_small_parts_find_the_pairs_that_trees_find(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << 62, size).astype(np.uint64) for size in (9, 40, 300, 1200)]
    sets = []
    for k in range(160):
        base = bases[k % 4]
        own = base[rng.random(len(base)) < random.Random(k).choice([0.75, 0.9, 1.0])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 62, 1 + len(base) // 20).astype(np.uint64)])))
    classes = ngram_join.size_class(np.array(list(map(len, sets)))).tolist()
    sigs = spark.createDataFrame([(k, len(s), bytearray(ngram_join.signature(s, ngram_join.width(g + 1)).tobytes())) for k, (s, g) in enumerate(zip(sets, classes, strict=True))], "sid long, n long, sig binary")
    posts = spark.createDataFrame([(h, k, len(s), k // 3) for k, s in enumerate(sets) for h in (k % 11, 100 + k % 4)], "h long, sid long, n long, comp long")
    found = []
    for leaf, part_rows in ((64, 4096), (0, 4096), (1000, 4096), (64, 10), (0, 10)):
        monkeypatch.setattr(ngram_join, "LEAF_ROWS", leaf)
        monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
        found.append({tuple(r) for r in ngram_join.tree_pairs(posts, sigs).collect()})
    assert found[0] and all(x == found[0] for x in found)
    links = {(a, b) for b in range(160) for a in range(b) if a // 3 != b // 3 and (a % 11 == b % 11 or a % 4 == b % 4) and ngram_join.linked(sets[a], sets[b])}
    assert links <= found[0] and links


@pytest.mark.parametrize(("buckets", "held"), [(1, 1 << 18), (3, 1), (4096, 100)])
def test_halves_are_counted_in_buckets(spark, tables, monkeypatch, buckets, held):
    passage = prose(42, 63, sentence=7)
    rows = [doc(i, f"{prose(100 + i, 60)} {passage if i % 3 else ''}\n{prose(300 + i // 2, 40)}") for i in range(40)] + [doc(None, passage), doc(50, None), doc(51, "")]
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    expected = Counter(r.h for r in sentence_spans.spans(docs).select("h").collect())
    monkeypatch.setattr(sentence_spans, "BUCKETS", buckets)
    monkeypatch.setattr(sentence_spans, "HELD_RUNS", held)
    several, _ = sentence_spans.repeated_halves(docs)
    got = [tuple(r) for r in several.select("h", "rows").collect()]
    assert got and sorted(got) == sorted((h, n) for h, n in expected.items() if n > 1)
    sc = spark.sparkContext
    dealt = sentence_spans.first_halves(docs.coalesce(1), sc.accumulator(0), sc.accumulator(0))
    assert "halves" in dealt.columns and (held < 1 << 18 or dealt.count() == buckets)  # before, a row for each run
