"""Operators 2 and 3 against brute force."""

import numpy as np
import pytest

from shelfspark.llm import hash_forest, norm_buckets

EMB = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every, whole):
    """Best rows of each query row; rows are told apart by place."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, np.floor(256 * v) if whole else v) for i, v in kept]
    if not whole:
        kept = [(i, v) for i, v in kept if len(v) and v.any()]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-float(v @ q), j) for b, (j, v) in enumerate(kept) if a != b and len(v) == len(q))
            out.append((i, [(j, -s) for s, j in scored[:k]]))
    return out


def grouped(got, k):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def make(n, dims, seed=0, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    X = np.where(rng.random((n, 1)) < 0.5, centres[rng.integers(0, clusters, n)] + 0.1 * rng.standard_normal((n, dims)), rng.standard_normal((n, dims))) * rng.uniform(0.5, 2, (n, 1))
    return [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(X)]


ODD = [(None, [1.0, 2.0, 3.0], 0), (2000, None, 0), (2050, [float("nan"), 1.0, 0.0], 0), (2100, [1.0, None, 0.0], 0), (2150, [float("inf"), 0.0, 0.0], 0), (2200, [], 0), (2250, [0.0, 0.0, 0.0], 0)]


def test_forest_recall(spark, tables):
    rows = make(3000, 16)
    got = grouped(hash_forest.op2_hash_forest(spark, tables(embeddings=(rows, EMB))).collect(), 20)
    hit = total = 0
    for i, best in brute(rows, 20, 20, False):
        assert len(got[i]) == 20 and [j for j, _ in got[i]] == [j for _, j in sorted((-s, j) for j, s in got[i])]
        hit += len({j for j, _ in best} & {j for j, _ in got[i]})
        total += 20
    assert hit / total >= 0.9


def test_forest_over_several_blocks_and_small_shares(spark, tables):
    from shelfspark.llm.common import table

    rows = make(1500, 8, 4)
    d = tables(embeddings=(rows, EMB))
    got = grouped(hash_forest.nearest(table(spark, d, "embeddings"), k=5, every=50, share=0.3, block_rows=400).collect(), 5)
    want = dict(brute(rows, 5, 50, False))
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) >= 0.8 * 5 * len(want)


def test_odd_rows_ties_and_few_candidates(spark, tables):
    rows = ODD + [(0, [1.0, 0.0, 0.0], 0), (20, [1.0, 0.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (100, [1.0, 0.0], 0), (7, [0.5, 0.0, 0.5], 0)]
    d = tables(embeddings=(rows, EMB))
    got = grouped(hash_forest.op2_hash_forest(spark, d).collect(), 20)
    assert got == {0: [(3, 1.0), (20, 1.0), (7, 0.5)], 20: [(0, 1.0), (3, 1.0), (7, 0.5)]}
    exact = grouped(norm_buckets.op3_norm_bucket_topk(spark, d).collect(), 5)
    want = {i: [(j, int(s)) for j, s in b] for i, b in brute(rows, 5, 50, True) if b}
    assert exact == want and 2250 in exact


def test_repeated_ids_answer_each_row(spark, tables):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [1.0, 1.0], 0)]
    got = hash_forest.op2_hash_forest(spark, tables(embeddings=(rows, EMB))).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]


@pytest.mark.parametrize("dims,block", [(16, 1 << 15), (3, 300)])
def test_exact_products(spark, tables, dims, block):
    from shelfspark.llm.common import table

    rows = make(1200, dims, 2)
    d = tables(embeddings=(rows, EMB))
    got = grouped(norm_buckets.largest_products(table(spark, d, "embeddings"), block_rows=block).collect(), 5)
    assert got == {i: [(j, int(s)) for j, s in b] for i, b in brute(rows, 5, 50, True)}


def test_pruning_by_length_and_coordinates_is_exact_and_saves_work():
    rng = np.random.default_rng(1)
    X = np.floor(256 * np.concatenate([rng.standard_normal((3000, 12)) * 0.2, np.eye(12)[rng.integers(0, 12, 600)] + 0.02 * rng.standard_normal((600, 12))]))
    index = norm_buckets.NormBuckets(np.arange(len(X)), np.arange(len(X)), X, 128)
    for q in range(3000, 3040):
        ids, scores = index.search(X[q], q, 5)
        s = X @ X[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(X)), -s))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == s[best].astype(int).tolist()
    assert index.verified < 0.5 * 40 * len(X)


def test_products_beyond_doubles():
    X = np.array([[2.0**40, 1.0], [3.0, 2.0**50], [-(2.0**43), 0.0]])
    assert norm_buckets.exact_products(X, np.array([2.0**20, 1.0])).tolist() == [2**60 + 1, 3 * 2**20 + 2**50, -(2**63)]
    with pytest.raises(OverflowError):
        norm_buckets.exact_products(X, np.array([2.0**21, 1.0]))


def test_a_thousand_equal_vectors_tie_by_id(spark, tables):
    from shelfspark.llm.common import table

    rng = np.random.default_rng(3)
    same = [float(np.float32(x)) for x in rng.standard_normal(33)]
    rows = [(i, same, 0) for i in rng.permutation(1001).tolist()] + [(5000 + i, [float(np.float32(x)) for x in 0.3 * rng.standard_normal(33)], 0) for i in range(300)]
    got = grouped(hash_forest.nearest(table(spark, tables(embeddings=(rows, EMB)), "embeddings"), k=20, every=100, share=1.0, block_rows=200).collect(), 20)
    assert {i for i in got if i <= 1000} == set(range(0, 1001, 100))
    for i in range(0, 1001, 100):
        assert [j for j, _ in got[i]] == [j for j in range(22) if j != i][:20] and len({s for _, s in got[i]}) == 1


def test_empty(spark, tables):
    d = tables(embeddings=([], EMB))
    assert hash_forest.op2_hash_forest(spark, d).count() == 0 and norm_buckets.op3_norm_bucket_topk(spark, d).count() == 0
