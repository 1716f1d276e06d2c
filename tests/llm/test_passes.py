"""Disk and thresholds: what is dealt out in passes, rows known by their files, quantiles of all held-out rows."""

import random

import numpy as np
import pytest

from shelfspark.llm import language, ngram_join, sentence_spans
from shelfspark.llm.common import table

from .conftest import DOCS, doc, prose


def near_copies(n=60):
    rows = []
    for i in range(n):
        words = prose(i // 4, 80).split()
        random.Random(i).shuffle(words[:3])
        words[i % 80] = f"w{i}"
        rows.append(doc(i, " ".join(words)))
    return rows


def recorded(monkeypatch):
    names = []
    real = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (names.append(name), real(df, name))[1])
    return names


def test_signatures_and_sets_are_dealt_out_in_passes(spark, tables, monkeypatch):
    d = tables(documents=(near_copies(), DOCS))
    whole = {tuple(r) for r in ngram_join.op10_ngram_jaccard(spark, d).collect()}
    monkeypatch.setattr(ngram_join, "PASS_ROWS", 1)
    monkeypatch.setattr(ngram_join, "PASS_SHARE", 0.1)
    names = recorded(monkeypatch)
    assert {tuple(r) for r in ngram_join.op10_ngram_jaccard(spark, d).collect()} == whole
    assert len({c for _, _, c in whole}) < len(whole)
    assert names.count("sets") > 2


def test_tree_passes_find_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    sets = [np.sort(np.concatenate([np.delete(base, k), rng.integers(0, 1 << 62, 1).astype(np.uint64)])) for k in range(30)]
    sigs = spark.createDataFrame([(k, len(s), bytearray(ngram_join.signature(s, 2048).tobytes())) for k, s in enumerate(sets)], "sid long, n long, sig binary")
    posts = spark.createDataFrame([(k % 5, k, len(s), k) for k, s in enumerate(sets)], "h long, sid long, n long, comp long")
    whole = {tuple(r) for r in ngram_join.tree_pairs(posts, sigs).collect()}
    monkeypatch.setattr(ngram_join, "PASS_ROWS", 4)
    monkeypatch.setattr(ngram_join, "PASS_SHARE", 0.1)
    names = recorded(monkeypatch)
    assert {tuple(r) for r in ngram_join.tree_pairs(posts, sigs).collect()} == whole
    assert whole == {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 5 == j % 5}
    assert names.count("tree-pairs") > 2


def test_rows_of_files_are_not_written_once_more(spark, tables, monkeypatch):
    d = tables(documents=(near_copies() + [doc(None, prose(0, 80)), doc(3, None), doc(3, None)], DOCS))
    docs = table(spark, d, "documents")
    names = recorded(monkeypatch)
    kept = sorted(map(str, ngram_join.keep_first(docs).collect()))
    assert "numbered" not in names
    assert kept == sorted(map(str, ngram_join.keep_first(docs.where("true or rand() > 2").limit(1000)).collect()))
    assert "numbered" in names
    n = ngram_join.numbered(docs, "at")
    assert n.columns == [*docs.columns, "at"] and n.select("at").distinct().count() == docs.count()
    clash = docs.withColumnRenamed("source", "_metadata")
    assert sorted(ngram_join.numbered(clash, "at").columns) == sorted([*clash.columns, "at"])


def test_thresholds_come_from_all_held_out_rows(spark, tables):
    rows = [doc(i, (prose(i, 12) if i % 2 else "".join(chr(0x430 + ord(c) % 32) if c.isalpha() else c for c in prose(i, 12))), "en" if i % 2 else "ru") for i in range(3000)]
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    model = language.learn(docs)
    held = docs.where(language.remainder(4) == 2)
    right = language.predict_language(held, model).where("lang_pred = lang").select("lang_score", "lang_fit").toPandas()
    assert len(right) > 2 * language.SAMPLE  # more rows than a sample of the two languages holds
    for got, c in zip(language.least_sure(docs, model), ("lang_score", "lang_fit"), strict=True):
        exact = language.SHARE * np.quantile(right[c], language.QUANTILE, method="lower")
        assert got == pytest.approx(exact, abs=1.01 / language.STEPS)


def test_whole_runs_are_dealt_out_in_passes(spark, tables, monkeypatch):
    passage = prose(42, 63, sentence=7)
    rows = [doc(i, f"{prose(100 + i, 60)} {passage if i % 3 else ''}\n{prose(300 + i // 2, 40)}") for i in range(40)]
    rows += [doc(None, passage), doc(7, passage), doc(7, passage), doc(50, None), doc(51, ""), doc(52, "a. " * 400)]
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    whole = sorted(map(str, sentence_spans.remove_repeats(docs).collect()))
    assert sum("n_removed=0" not in r for r in whole) > 20
    runs, size = sentence_spans.spans(docs).count(), sum(len(r[1] or "") for r in rows)
    names, dealt, cut, spans = [], [], sentence_spans.cut, sentence_spans.spans
    monkeypatch.setattr(sentence_spans, "PASS_RUNS", 1)
    monkeypatch.setattr(sentence_spans, "cut", lambda df, name: (names.append(name), cut(df, name))[1])
    monkeypatch.setattr(sentence_spans, "spans", lambda *given: (dealt.append(spans(*given)), dealt[-1])[1])
    for share in (28, 60):
        names.clear(), dealt.clear()
        monkeypatch.setattr(sentence_spans, "PASS_BYTES", share)
        assert sorted(map(str, sentence_spans.remove_repeats(docs).collect())) == whole
        sizes = [d.count() for d in dealt]
        assert sum(sizes) == runs and len(sizes) == names.count("shared-runs") > 1
        assert max(sizes) < 1.5 * size / share  # before, one step dealt out all of them


@pytest.mark.parametrize("rows", [[], [doc(1, None)], [doc(1, "")]])
def test_passes_of_no_runs(spark, tables, rows):
    d = tables(documents=(rows, DOCS))
    got = sentence_spans.op8_sentence_spans(spark, d).collect()
    assert [tuple(r) for r in got] == [(i, text, 0, 0) for i, text, *_ in rows]
