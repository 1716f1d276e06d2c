"""Operators 1, 4, 8 and 10, and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import common, components, grams, language, ngram_join, quality, sentence_spans, shingles
from shelfspark.llm.common import table
from shelfspark.llm.grams import joined
from shelfspark.llm.shingles import range_hashes, shingle_sets, words_of

from .conftest import DOCS, doc, prose

LABELS = "doc_id long, quality int, toxic int"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


# --- quality -------------------------------------------------------------------------------------------------------
def quality_corpus(n=240):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(i, 60) if good else " ".join(w.upper() + "!!" for w in prose(i, 60).split()) if i % 2 else (prose(i, 3) + " ") * 25
        rows.append(doc(i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_is_learned_and_held_out_rows_are_right(spark, tables):
    rows, labels = quality_corpus()
    odd = [doc(1000, None), doc(1001, ""), doc(None, "no id here"), doc(1002, "x"), doc(1003, prose(5, 30_000))]
    d = tables(documents=(rows + odd, DOCS), labels=(labels + [(None, 1, 0), (5, None, 0)], LABELS))
    got = {r.doc_id: r for r in quality.op1_quality_knn(spark, d).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    right = [got[i].predicted == y for i, y, _ in labels if held(i, 5, 0)]
    assert np.mean(right) > 0.95 and all(got[i].held_out == held(i, 5, 0) for i, *_ in labels)
    assert got[1000].score == got[1001].score and got[None].held_out is False


def test_quality_votes_are_those_of_brute_force(spark):
    rows, labels = quality_corpus(120)
    X = quality.features(pa.array([r[1] for r in rows]))
    y = np.array([q for _, q, _ in labels])
    model = quality.fit(X, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    P = model.project(X)
    for i in (0, 7, 50):
        near = sorted(range(len(y)), key=lambda j: -float(P[i] @ P[j]))[: quality.NEIGHBOURS]
        w = [max(0.0, float(P[i] @ P[j])) ** quality.POWER for j in near]
        assert model.scores(X[i : i + 1])[0] == pytest.approx(sum(a * y[j] for a, j in zip(w, near)) / sum(w), abs=1e-4)


def test_quality_without_labels(spark, tables):
    d = tables(documents=([doc(1, "some text")], DOCS), labels=([], LABELS))
    assert [(r.score, r.predicted) for r in quality.op1_quality_knn(spark, d).collect()] == [(1.0, 1)]
    assert quality.op1_quality_knn(spark, tables(documents=([], DOCS), labels=([], LABELS))).count() == 0


# --- language ------------------------------------------------------------------------------------------------------
SYLLABLES = {"en": "the and ing tion er th sh ou", "de": "der und ung sch ich ver ein ä", "fr": "les eau tion que é è oi des", "es": "los ción ado que ñ ar os del"}


def words(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_languages(spark, tables):
    rows = [doc(i, words(lang, i, 3 + i % 40), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    odd = [doc(900, None), doc(901, ""), doc(902, "12 -- 34 !!"), doc(None, "the andthe ing"), doc(903, words("fr", 1, 20_000), None), doc(904, "中文", None)]
    got = {r.doc_id: r for r in language.op4_language_svm(spark, tables(documents=(rows + odd, DOCS))).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows if held(i, 4, 2)]) > 0.97
    assert all(got[i].held_out == held(i, 4, 2) for i, *_ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "fr" and got[904].lang_pred in SYLLABLES and all(0 <= r.score <= 1 for r in got.values())


def test_language_hierarchy():
    assert language.family("en-US") == "germanic" and language.family("pt_BR") == "romance" and language.family("zz") == "zz"
    langs = np.array(["en", "de", "fr", "es", "ja"] * 20)
    X = np.eye(8, dtype=np.float32)[[0, 1, 2, 3, 4] * 20] + 0.3 * np.eye(8, dtype=np.float32)[[5, 5, 6, 6, 7] * 20]
    model = language.LanguageModel(X, langs)
    assert model.upper.names == ["germanic", "ja", "romance"] and [m.names for m in model.lower] == [["de", "en"], ["ja"], ["es", "fr"]]
    assert model.predict(X)[0] == langs.tolist()


def test_one_language_none_and_no_rows(spark, tables):
    one = tables(documents=([doc(i, "some words here") for i in range(9)], DOCS))
    assert {r.lang_pred for r in language.op4_language_svm(spark, one).collect()} == {"en"}
    none = tables(documents=([doc(i, "some words here", None) for i in range(3)], DOCS))
    assert {(r.lang_pred, r.score) for r in language.op4_language_svm(spark, none).collect()} == {("und", 0.0)}
    assert language.op4_language_svm(spark, tables(documents=([], DOCS))).count() == 0


def test_many_languages_and_one_id_of_many_rows(spark, tables):
    langs = [f"l{k:02d}" for k in range(60)]
    rows = [doc(i, " ".join(random.Random(1000 * (i % 60) + j % 7).choice(["ba", "ce", "di", "fo", "gu"]) + chr(97 + (i % 60) % 26) + chr(97 + (i % 60) // 3) for j in range(30)), langs[i % 60]) for i in range(1200)]
    rows += [doc(7_000_001, "ein text", "l00")] * 5000 + [doc(7_000_001, "noch einer", "l01")] * 2000
    docs = table(spark, tables(documents=(rows, DOCS)), "documents")
    sample = language.labelled(docs, False, 250)
    got = sample.groupBy("lang").count().collect()
    assert {r.lang for r in got} == set(langs) and sum(r["count"] for r in got) <= 2 * language.MOST_ROWS
    assert sample.where("doc_id = 7000001").count() == 2 * (not held(7_000_001, 4, 2))
    pred = {r.doc_id: r for r in language.predict_language(docs.where("doc_id < 1200"), language.learn(docs)).collect()}
    assert np.mean([pred[i].lang_pred == langs[i % 60] for i in range(1200)]) > 0.95


def test_machines_against_brute_force():
    """Families first, then a vote of every pair inside the family, one row and one pair at a time."""
    langs = ["en", "de", "nl", "fr", "es", "zz"]
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 40))
    X = np.repeat(centres, 20, 0) + 0.6 * rng.standard_normal((120, 40))
    X = (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)
    y = np.repeat(langs, 20)
    model = language.LanguageModel(X, y)
    names, _ = model.predict(X)

    def vote(level, x):
        wins, margin = dict.fromkeys(level.names, 0), dict.fromkeys(level.names, 0.0)
        for w, (a, b) in zip(level.weights, level.pairs, strict=True):
            m = float(np.append(x, 1) @ w)
            wins[level.names[a] if m > 0 else level.names[b]] += 1
            margin[level.names[a]] += np.tanh(m)
            margin[level.names[b]] -= np.tanh(m)
        return max(level.names, key=lambda n: (wins[n], margin[n]))

    for x, name in zip(X, names, strict=True):
        family = vote(model.upper, x)
        assert name == vote(model.lower[model.upper.names.index(family)], x)
    assert np.mean(np.array(names) == y) > 0.95 and {language.family(n) for n in langs} == set(model.upper.names)


# --- n-gram join ---------------------------------------------------------------------------------------------------
def plain_set(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, plain_set(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(x for x in (least.get(find(a)), i) if x is not None) if i is not None or find(a) in least and least[find(a)] is not None else None
    return sorted(repr((i, len(s), i if not s else least[find(a)])) for a, (i, s) in enumerate(sets))


def near(text, seed, edits):
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
    return " ".join(w)


def join_corpus():
    rows, i = [], 0
    common = prose(777, 30)
    for family in range(12):
        base = prose(family, 60 + 25 * family)
        for k in range(8):
            rows.append(doc(i := i + 1, near(base, k, k // 2)))
    for k in range(25):  # a passage that many share without being copies
        rows.append(doc(i := i + 1, common + " " + prose(5000 + k, 20 + k)))
    for k in range(6):  # a chain: each links with the next only
        w = prose(31, 200).split(" ")
        rows.append(doc(i := i + 1, " ".join(w[8 * k : 8 * k + 100])))
    short = ["one two three", "One TWO three", "one two", "", None, "  \t\n ", "a b", "É f", "é f", "x " * 500, "x " * 700]
    return rows + [doc(i + 1 + k, t) for k, t in enumerate(short)] + [doc(3, rows[2][1])]


def test_join_against_brute_force(spark, tables):
    rows = join_corpus()
    got = ngram_join.op10_ngram_jaccard(spark, tables(documents=(rows, DOCS))).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows)


def test_join_without_ids_and_empty(spark, tables):
    text = prose(1, 100)
    rows = [doc(None, text), doc(4, near(text, 1, 1)), doc(9, text), doc(None, prose(2, 50))]
    got = ngram_join.op10_ngram_jaccard(spark, tables(documents=(rows, DOCS))).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (9, 4)]
    assert ngram_join.op10_ngram_jaccard(spark, tables(documents=([], DOCS))).count() == 0


def test_split_blocks_lose_no_pair(spark, tables, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 3)
    rows = join_corpus()
    got = ngram_join.op10_ngram_jaccard(spark, tables(documents=(rows, DOCS))).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows)


@pytest.mark.parametrize("seed", range(5))
def test_signature_tree_excludes_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, rng.integers(1, 200), np.uint64) for _ in range(15)]
    sets = []
    for b in base:
        for _ in range(rng.integers(1, 12)):
            s = b[rng.random(len(b)) > 0.1]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 62, max(1, len(b) // 20), np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    sigs = np.array([ngram_join.signature(s, 512) for s in sets]).view(np.uint64)
    found = {frozenset(p) for a, b in ngram_join.SignatureTree(sizes, sigs).close_pairs(chunk=7) for p in zip(a.tolist(), b.tolist(), strict=True)}
    links = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if ngram_join.linked(sets[a], sets[b])}
    assert links and links <= found and len(found) < 3 * len(links) + len(sets)


def test_linked_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert ngram_join.linked(a, a[:75]) and not ngram_join.linked(a, a[:74])
    assert ngram_join.linked(a[:6], np.arange(7, dtype=np.uint64)) and not ngram_join.linked(a[:1], a[:2])


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e f", "A  B\tc\nd e\x0bf", "a b c d f e", "a b c d e", "abc", None, " "]
    s = [tuple(x.tolist()) for x in shingle_sets(pa.array(texts))]
    assert s[0] == s[1] != s[2] and len(s[0]) == 2 and len(s[3]) == 1 and s[3][0] in s[0] and len(s[4]) == 1 and s[5] == s[6] == ()


def thue_morse(n, a, b):
    """A sequence and its complement: polynomial hashes modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [[a, b][x] for x in bits], [[b, a][x] for x in bits]


def test_no_texts_hash_alike_by_construction(spark, tables):
    one, two = ("".join(x) for x in thue_morse(1024, "a", "b"))  # words of 1024 letters
    first, second = (" ".join(x) for x in thue_morse(1024, "a", "b"))  # 1024 words
    rows = [doc(1, one), doc(2, two), doc(3, "a b c d " + one), doc(4, "a b c d " + two)]
    got = {r.doc_id: r.component_id for r in ngram_join.op10_ngram_jaccard(spark, tables(documents=(rows, DOCS))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    words = words_of(*joined(pa.array([first, second])))
    a, b = np.array([0, 1024, 0]), np.array([1024, 2048, 1024])
    for lane in words.hashes:
        h = range_hashes(lane, a, b)
        assert h[0] != h[1] and h[0] == h[2]
    passage = prose(77, 60, sentence=12).split()
    rows = [doc(1, " ".join(passage + [one] * 30)), doc(2, " ".join([two] * 30 + prose(78, 60, sentence=12).split()))]
    assert [r.n_removed for r in sentence_spans.op8_sentence_spans(spark, tables(documents=(rows, DOCS))).orderBy("doc_id").collect()] == [0, 0]


def test_words_do_not_depend_on_windows(monkeypatch):
    texts = pa.array([prose(k, 50) + "\u00e9\n" * (k % 3) for k in range(20)] + ["", None, "x" * 500, " y "])
    whole = words_of(*joined(texts))
    monkeypatch.setattr(shingles, "WINDOW", 64)
    parts = words_of(*joined(texts))
    assert all((getattr(whole, c) == getattr(parts, c)).all() for c in ("hashes", "at", "start", "end"))
    flat = " ".join(x for x in texts.to_pylist() if x).lower().split()
    assert len(whole.start) == len(flat) == whole.at[-1] and len(set(whole.hashes[0].tolist())) == len(set(flat))


def test_features_do_not_depend_on_steps(monkeypatch):
    texts = pa.array([prose(k, 5 + 40 * (k % 4)) for k in range(30)] + ["", None, "ab", "x" * 700])
    whole = quality.features(texts), language.features(texts)
    monkeypatch.setattr(grams, "STEP", 101)
    assert (quality.features(texts) == whole[0]).all() and (language.features(texts) == whole[1]).all()
    for k in range(len(texts)):
        assert (quality.features(texts[k : k + 1])[0] == whole[0][k]).all() and np.allclose(language.features(texts[k : k + 1])[0], whole[1][k], atol=1e-6)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1040)] + [(k, k + 1) for k in range(2000, 2050)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- sentence spans ------------------------------------------------------------------------------------------------
def slow_sentences(text):
    """[(start, words)] by the rules, one word at a time."""
    out, start, pieces = [], None, []
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for k, m in enumerate(found):
        if start is None:
            start = m.start()
        pieces.append(m[0].lower())
        end = k + 1 == len(found) or m[0][-1] in ".!?。" or "\n" in text[m.end() : found[k + 1].start()]
        if end:
            out.append((start, pieces))
            start, pieces = None, []
    return out


def slow_removal(rows):
    """Texts after removal, for rows whose sentences are short."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        sents = slow_sentences(text)
        gone = [False] * len(sents)
        for a in range(len(sents)):
            b, n = a, 0
            while b < len(sents) and (b - a < sentence_spans.RUN or n < sentence_spans.LEAST_WORDS):
                n += len(sents[b][1])
                b += 1
            if b - a < sentence_spans.RUN or n < sentence_spans.LEAST_WORDS:
                continue
            key = tuple(w for s in sents[a:b] for w in s[1])
            if key in seen:
                for k in range(a, b):
                    gone[k] = True
            seen.setdefault(key, i)
        cuts = [0, *(s for s, _ in sents[1:]), len(text)]
        out[i] = (text if not any(gone) else "".join(text[cuts[k] : cuts[k + 1]] for k in range(len(sents)) if not gone[k]), sum(gone))
    return out


def span_corpus():
    passage = prose(42, 63, sentence=7)
    rows = [(i, prose(100 + i, 90, sentence=8)) for i in range(12)]
    rows += [(20, prose(1, 40) + " " + passage + " " + prose(2, 40)), (21, passage), (22, "Lead in\n" + passage.upper() + "\n" + prose(3, 50)), (23, passage + " " + passage)]
    rows += [(30, "Yes. No. Yes. No."), (31, "Yes. No. Yes. No."), (32, prose(4, 50) + " Released under the MIT License."), (33, prose(5, 50) + " Released under the MIT License.")]
    return rows


@pytest.mark.parametrize("hot", [10_000, 1])
def test_spans_against_a_loop(spark, tables, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = span_corpus()
    d = tables(documents=([doc(i, t) for i, t in rows] + [doc(40, None), doc(41, ""), doc(42, "  ")], DOCS))
    got = {r.doc_id: r for r in sentence_spans.op8_sentence_spans(spark, d).collect()}
    for i, (text, n) in slow_removal(rows).items():
        assert (got[i].text, got[i].n_removed) == (text, n), i
    assert got[40].text is None and got[41].text == "" and got[42].text == "  " and got[21].n_removed == 8 and got[20].n_removed == 0  # the first sentence of the passage is glued to another there


def test_passages_of_few_sentences_glued_to_other_text(spark, tables):
    rows, passages = [], {}
    for k in range(30):
        passages[k] = prose(9000 + k, 51, sentence=17)
        lead, more = prose(9100 + k, 8, sentence=10**9), prose(9200 + k, 8, sentence=10**9)
        other, rest = prose(9300 + k, 11, sentence=10**9), prose(9400 + k, 6, sentence=10**9)
        # free; glued at the start; glued at both ends, without its last stop
        rows += [doc(10 * k, passages[k] + "\n" + prose(9500 + k, 40)), doc(10 * k + 1, lead + " " + passages[k] + "\n" + more), doc(10 * k + 2, other + " " + passages[k][:-1] + " " + rest)]
    got = {r.doc_id: r for r in sentence_spans.op8_sentence_spans(spark, tables(documents=(rows, DOCS))).collect()}
    for k in range(30):
        lost = [len(rows[3 * k + j][1].split()) - len(got[10 * k + j].text.split()) for j in range(3)]
        assert lost[0] == got[10 * k].n_removed == 0 and 30 <= lost[1] <= 51 and 30 <= lost[2] <= 51, (k, lost)
        lead, rest = rows[3 * k + 1][1].split()[:8], rows[3 * k + 2][1].split()[-6:]
        assert got[10 * k + 1].text.split()[:8] == lead and got[10 * k + 2].text.split()[-6:] == rest


def test_repeats_without_full_stops(spark, tables):
    passage = prose(8, 120, sentence=10**9)
    rows = [doc(1, prose(1, 33, sentence=10**9) + " " + passage + " " + prose(2, 50, sentence=10**9)), doc(2, prose(3, 47, sentence=10**9) + " " + passage), doc(3, "la " * 300), doc(4, "mi la " + "la " * 200)]
    got = {r.doc_id: r.text for r in sentence_spans.op8_sentence_spans(spark, tables(documents=(rows, DOCS))).collect()}
    assert got[1] == rows[0][1] and passage[100:-100] not in got[2] and len(got[2].split()) < 47 + 45 and got[2].startswith(prose(3, 30, sentence=10**9))
    assert len(got[4].split()) < 40


def test_repeated_rows_keep_the_same_and_other_columns_stay(spark, tables):
    text = prose(1, 80)
    rows = [doc(1, text, "en", "a"), doc(1, text, "en", "b"), doc(2, text, "de", "c"), doc(None, text, "fr", "d")]
    d = tables(documents=(rows, DOCS))
    got = sentence_spans.remove_repeats(table(spark, d, "documents")).collect()
    assert sorted((r.source, r.n_removed > 0) for r in got) == [("a", True), ("b", True), ("c", True), ("d", False)]
    assert sentence_spans.op8_sentence_spans(spark, tables(documents=([], DOCS))).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline as cp

    rows, labels = quality_corpus(180)
    rows = [(*r[:2], "en" if k % 2 else "de", *r[3:]) for k, r in enumerate(rows)]
    passage = prose(4242, 70)
    rows += [doc(500 + k, prose(600 + k, 40) + " " + passage) for k in range(5)] + [doc(520 + k, near(prose(700, 200), k, 1)) for k in range(4)] + [doc(530, "1234 5678"), doc(531, None)]
    d = tables(documents=(rows, DOCS), labels=(labels, LABELS))
    docs, kept = table(spark, d, "documents"), []
    for name, f in cp.STAGES[:-1]:
        got = f(spark, docs, d)
        assert got.columns == docs.columns, name
        path = f"{d}/stage-{len(kept)}"
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = {i for i, y, _ in labels if y}
    assert len(kept[0].keys() & good) > 0.98 * len(good) and len(kept[0].keys() - good - set(range(500, 600))) <= 4
    assert 530 not in kept[1] and 531 not in kept[1] and len(kept[1]) >= len(kept[0]) - 3
    assert [i for i in range(520, 524) if i in kept[2]] == [520] and all(i in kept[2] for i in range(500, 505))
    assert kept[3][500] == kept[2][500] and all(passage[50:-50] not in kept[3][i] for i in range(501, 505))
    packed = cp.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "language id", "n-gram jaccard join", "substring dedup", "best-fit packing"]


def test_pipeline_rejects_languages_that_were_not_learned(spark, tables):
    import corpus_pipeline as cp

    rows = [doc(i, words(lang, i, 20 + i % 40), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    rng = random.Random(5)
    other = ["今天天气很好我们一起去公园散步" * 9, "сегодня хорошая погода и мы идем гулять в парк " * 9, " ".join("".join(rng.choices("bcdfgjkmpqvwxyz", k=7)) for _ in range(90))]
    odd = [doc(900 + k, t, None) for k, t in enumerate(other)] + [doc(910 + k, words(lang, 7000 + k, 60), None) for k, lang in enumerate(["en", "de", "fr", "es"])]
    for given, clean in ((rows, range(910, 914)), (rows[::4], [910])):  # four languages, and one whose score is always 1
        docs = table(spark, tables(documents=(given + odd, DOCS)), "documents")
        kept = {r.doc_id for r in cp.language_stage(spark, docs, "").collect()}
        assert not kept & {900, 901, 902} and kept >= set(clean) and len(kept & {r[0] for r in given}) >= 0.98 * len(given)


def test_near_copies_with_repeated_and_missing_ids(spark, tables):
    import corpus_pipeline as cp

    copied, own = prose(800, 120), prose(801, 120)
    rows = [doc(1, copied), doc(2, near(copied, 3, 1)), doc(2, own), doc(2, own), doc(None, near(copied, 4, 1)), doc(None, prose(802, 120)), doc(None, near(prose(802, 120), 5, 1)), doc(3, None)]
    got = cp.near_copies_stage(spark, table(spark, tables(documents=(rows, DOCS)), "documents"), "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=repr)
    assert [x for x in kept if x[0] is not None] == [(1, copied), (2, own), (3, None)]
    assert len(kept) == 4 and [t for i, t in kept if i is None][0] in (rows[5][1], rows[6][1])


def test_columns_of_clashing_names_pass_every_stage(spark, tables):
    import corpus_pipeline as cp

    rows, labels = quality_corpus(60)
    copies = [doc(100 + k, prose(700, 120)) for k in range(3)]
    d = tables(documents=(rows + copies, DOCS), labels=(labels, LABELS))
    names = "quality_score lang_pred lang_score lang_fit _th _id _t starts _doc _starts n_sentences n_removed _row _first _k comp sid component_id text_ h salt place tie Text2".split()
    docs = table(spark, d, "documents")
    docs = docs.select(*docs.columns, *(F.lit(f"own {n}").alias(n) for n in names))
    for name, f in cp.STAGES[:-1]:
        got = f(spark, docs, d)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert kept and all(r[n] == f"own {n}" for r in kept for n in names), name
    assert cp.STAGES[-1][1](spark, docs, d).count() >= len(rows)


def test_stages_over_nothing_nulls_and_long_texts(spark, tables):
    import corpus_pipeline as cp

    rows, labels = quality_corpus(40)
    long = prose(5, 200_000)
    for given in ([], [doc(None, None), doc(None, ""), doc(1, None), doc(1, ""), doc(2, " ")], [doc(1, long), doc(2, long + " x"), doc(3, long[:-30])]):
        d = tables(documents=(given, DOCS), labels=(labels, LABELS))
        docs = table(spark, d, "documents")
        assert cp.quality_stage(spark, docs, d).count() <= len(given) and cp.language_stage(spark, docs, d).count() <= len(given)
        assert cp.near_copies_stage(spark, docs, d).count() == (1 if given and given[0][1] == long else len(given))
        cleaned = {r.doc_id: r.text for r in cp.repeats_stage(spark, docs, d).collect()}
        assert all(len(t) < 200 for i, t in cleaned.items() if i in (2, 3) and t) and (not given or given[0][1] != long or cleaned[1] == long)
        assert cp.packing_stage(spark, docs, d).count() >= len(given)
