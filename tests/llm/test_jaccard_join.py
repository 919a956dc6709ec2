import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brandlens.llm import jaccard_join as X

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(rows, k=4, percent=85):
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            lists[x].append(i)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in members[root(i)] if x is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else doc_id))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(docs).collect()), key=repr)
    assert found == brute(rows)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    line = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for i in range(120):  # a family of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, line + " " + " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120, 200)]
    rows += [(i, line.upper()) for i in range(200, 230)]
    rows += [(i, rng.choice(["", "a", "A b", "a B", "x y z", " \t", "a\x1cb c d e f"])) for i in range(230, 260)]
    rows += [(i, " ".join(base[:rng.randint(3, 14)] + [f"q{i % 3}"])) for i in range(260, 320)]
    return rows


@pytest.mark.parametrize("long", [3, 32])
def test_components_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(X, "LONG", long)
    check(spark, corpus())


def test_blocks_find_what_pivots_leave(spark, monkeypatch):
    """Without pivots all links of long lists come from blocks; the components are the same."""
    monkeypatch.setattr(X, "LONG", 3)
    monkeypatch.setattr(X, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(X, "BLOCK_NODES", 16)
    monkeypatch.setattr(X, "COUNTED", 64)
    check(spark, corpus()[:150])


def test_common_counts(monkeypatch):
    monkeypatch.setattr(X, "COUNTED", 7)
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 50, k)).astype(np.uint64) for k in rng.integers(1, 40, 12)] for _ in range(2))
    assert (X.common_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_links_of_blocks_join_each_component_once():
    one = np.arange(20, dtype=np.uint64).tobytes()
    block = [{"node": i, "component": i // 2, "shingles": one} for i in range(10)]
    found = X.joining_links(block, block)
    assert len(found) == 4  # five components, joined by four links


def test_odd_rows(spark, odd_docs, texts, no_docs):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(odd_docs).collect()), key=repr)
    assert found == brute(texts)
    assert X.join(no_docs).collect() == []
    stays = X.representatives(odd_docs)
    assert stays.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in stays.collect()), key=repr)
    assert ids == sorted([1, 3, 4, None, 5, 5, 6, 6, 7, 8, 9, 10, 11], key=repr)


def test_bounds_of_the_search():
    for n in range(1, 3000):
        partners = range(-(-n * 85 // 100), n * 100 // 85 + 1)
        assert X.lowest_wanted(n) <= min(X.wanted(m) for m in partners)
        assert X.wanted(n) <= X.least_overlap(n) <= n


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(2))
        n = len(np.intersect1d(a, b))
        assert X.similar(a, b) == (100 * n >= 85 * (len(a) + len(b) - n))


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 60)])
def test_bounds_hold_for_other_similarities(words, percent):
    rng = np.random.default_rng(6)
    for n in range(1, 1500):
        partners = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
        assert X.lowest_wanted(n, percent) <= X.wanted(partners, percent).min()
    for _ in range(500):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(2))
        n = len(np.intersect1d(a, b))
        assert X.similar(a, b, percent) == (100 * n >= percent * (len(a) + len(b) - n))


@pytest.mark.parametrize("long", [3, 32])
def test_components_of_other_shingles_and_similarity(spark, monkeypatch, long):
    monkeypatch.setattr(X, "LONG", long)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(docs, 5, 80).collect()), key=repr)
    assert found == brute(rows, 5, 80)
    assert found != brute(rows)
