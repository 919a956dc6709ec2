"""Pivot index against brute force."""

import numpy as np
import pytest

from brandlens.llm import pivot_index as X

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies int"


def near(rng, x, cosine):
    r = X.unit(rng.normal(size=x.shape))
    r = X.unit(r - (r * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine ** 2) * r


def vectors(seed=3, n=1500, d=32):
    """Random vectors, copies, pairs a little above and below the cosine, a large family."""
    rng = np.random.default_rng(seed)
    plain = X.unit(rng.normal(size=(n, d)))
    family = near(rng, np.repeat(plain[:1], 400, 0), 0.985)
    made = np.concatenate([plain, plain[10:40], plain[10:20] * 3, near(rng, plain[100:400], 0.952),
                           near(rng, plain[400:500], 0.948), family]).astype(np.float32)
    ids = rng.permutation(len(made)) * 3
    return ids.tolist(), made


def brute(ids, made):
    v = X.unit(made.astype(np.float64))
    hit = v @ v.T >= X.COSINE
    np.fill_diagonal(hit, False)
    order = np.argsort(ids)
    a, b = np.nonzero(hit[np.ix_(order, order)])
    root = X.roots(len(ids), a, b)
    return hit.sum(1), {ids[order[i]]: ids[order[r]] for i, r in enumerate(root.tolist())}


@pytest.mark.parametrize("block", [X.BLOCK, 64])
def test_links_against_brute_force(spark, block):
    """With small blocks the lists are divided and dealt out; the links are the same."""
    ids, made = vectors()
    rows = [(i, v.tolist(), 1, "x", 7) for i, v in zip(ids, made, strict=True)]
    found = {r.vec_id: r for r in X.link(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block).collect()}
    degree, component = brute(ids, made)
    n = sum(r.n_links for r in found.values())
    assert len(found) == len(ids) and n >= 0.98 * degree.sum()
    assert all(found[i].n_links <= k for i, k in zip(ids, degree.tolist(), strict=True))  # none below the cosine
    wrong = sum(found[i].component_id != component[i] for i in ids)
    assert wrong <= 0.02 * len(ids)


@pytest.mark.parametrize("pivots", [256, 4096])
def test_recall_at_the_lowest_cosine(pivots):
    """Pairs at exactly 0.95 share pivots enough."""
    rng = np.random.default_rng(5)
    points = X.unit(rng.normal(size=(pivots, 64)))
    x = X.unit(rng.normal(size=(1000, 64)))
    a, b = (np.argpartition(-(v @ points.T), X.NEAREST, axis=1)[:, :X.NEAREST] for v in (x, near(rng, x, 0.95)))
    shared = np.array([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    assert (shared >= X.SHARED).mean() > 0.98


def test_pivots_lie_apart():
    rng = np.random.default_rng(1)
    one = X.unit(rng.normal(size=(1, 16)))
    sample = np.concatenate([near(rng, np.repeat(one, 900, 0), 0.97), X.unit(rng.normal(size=(900, 16)))])
    taken = X.spread(X.unit(sample), 64)
    close = taken @ taken.T
    np.fill_diagonal(close, -1)
    assert len(taken) == 64 and close.max() < X.SPREAD + 1e-6
    assert (taken @ one.T > 0.9).sum() <= 1  # a hot group has one pivot


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, "a", 1), (2, [2.0, 0.0], 0, "a", 1), (2, [2.0, 0.0], 0, "a", 1), (3, None, 0, "a", 1),
            (4, [0.0, 0.0], 0, "a", 1), (5, [nan, 1.0], 0, "a", 1), (6, [inf, 1.0], 0, "a", 1), (7, [None, 1.0], 0, "a", 1),
            (8, [], 0, "a", 1), (9, [1.0, 0.0, 0.0], 0, "a", 1), (None, [0.0, 1.0], 0, "a", 1),
            (None, [1e-30, 0.0], 0, "a", 1), (10, [-1.0, 0.0], 0, "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in X.link(df).collect()), key=repr)
    assert found == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7),
                            (8, 0, 8), (9, 0, 9), (None, 0, None), (None, 3, 1), (10, 0, 10)], key=repr)
    assert X.link(df.limit(0)).collect() == []
    nothing = X.link(df.filter("vec_id in (3, 4)")).collect()
    assert sorted(map(tuple, nothing)) == [(3, 0, 3), (4, 0, 4)]
    wide = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, X.link(wide).collect())) == [(1, 1, 1), (2, 1, 1)]
