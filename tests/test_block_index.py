import math
import random

import pytest
from pyspark.sql import functions as F

from brandlens.config import BM25_B, BM25_K1
from brandlens.functions.text import tokenise_py
from brandlens.operators.block_index import build_index, top_k


def full_scores(rows, queries, k):
    tokens = [tokenise_py(t or "") for _, t in rows]
    average = sum(map(len, tokens)) / len(tokens)
    df = {w: sum(w in t for t in tokens) for w in {w for t in tokens for w in t}}
    best = {}
    for number, text in queries:
        scores = []
        for (doc, _), own in zip(rows, tokens):
            score = 0.0
            for w in tokenise_py(text or ""):
                tf = own.count(w)
                if tf:
                    idf = math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    score += idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * len(own) / average))
            if score:
                scores.append((-round(score, 4), doc))
        best[number] = [(d, -s) for s, d in sorted(scores)[:k]]
    return best


def corpus(seed, n, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(d, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for d in range(n)], vocabulary


@pytest.mark.parametrize("block, k", [(8, 10), (1, 3), (1000, 5), (16, 700)])
def test_equals_full_scoring(spark, block, k):
    rows, vocabulary = corpus(block, 600)
    rng = random.Random(k)
    queries = [(q, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 6)))) for q in range(25)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    index = build_index(docs, ["id"], ["id"], block=block)
    best, read = top_k(index, spark.createDataFrame(queries, "query_id long, query string"), k)
    found = {}
    for r in best.orderBy("query_id", "rnk").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rnk == len(found[r.query_id])
    expected = {q: hits for q, hits in full_scores(rows, queries, k).items() if hits}
    assert {q: [d for d, _ in hits] for q, hits in found.items()} == {q: [d for d, _ in h] for q, h in expected.items()}
    assert all(math.isclose(a, b, abs_tol=1e-4) for q in found for (_, a), (_, b) in zip(found[q], expected[q]))
    counts = read.agg(F.sum("n_blocks"), F.sum("n_scored")).first()
    assert counts[1] <= counts[0]
    if block <= 8:
        assert counts[1] < counts[0]
    if k == 700:
        assert counts[1] == counts[0]  # no query has so many hits


def test_blocks_below_the_reached_score_are_skipped(spark):
    rng = random.Random(1)
    # documents about a subject arrive together; elsewhere its word is used in passing
    rows = [(d, " ".join(["engine"] * (9 if d // 20 == 7 else 1) + rng.choices([f"w{i}x" for i in range(200)], k=30)))
            for d in range(2000)]
    index = build_index(spark.createDataFrame(rows, "id long, text string"), ["id"], ["id"], block=10)
    queries = [(1, "engine"), (2, "engine w3x")]
    best, read = top_k(index, spark.createDataFrame(queries, "query_id long, query string"))
    expected = full_scores(rows, queries, 10)
    assert {(r.query_id, r.rnk): r.id for r in best.collect()} == {
        (q, i): d for q, hits in expected.items() for i, (d, _) in enumerate(hits, 1)}
    scored = {r.query_id: (r.n_blocks, r.n_scored) for r in read.collect()}
    assert scored[1] == (200, 10) and scored[2][1] < scored[2][0] == 200


def test_a_term_of_every_document_and_ties(spark):
    rows = [(d, "same text again") for d in range(300)] + [(900, "same same rare")]
    index = build_index(spark.createDataFrame(rows, "id long, text string"), ["id"], ["id"], block=16)
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] == 16
    best, _ = top_k(index, spark.createDataFrame([(1, "same"), (2, "rare rare")], "query_id long, query string"), 3)
    assert [(r.query_id, r.id) for r in best.orderBy("query_id", "rnk").collect()] == [(1, 900), (1, 0), (1, 1), (2, 900)]


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "crash " * 50_000), (4, "crash report"), (4, "crash report")]
    docs = spark.createDataFrame([(i, s, t) for s, (i, t) in enumerate(rows)], "id long, seq long, text string")
    queries = spark.createDataFrame([(1, "crash"), (2, None), (3, ""), (4, "absent"), (None, "report")],
                                    "query_id long, query string")
    best, read = top_k(build_index(docs, ["id"], ["seq"]), queries)
    hits = sorted(((r.query_id, r.id) for r in best.collect()), key=repr)
    assert [h for h in hits if h[0] == 1] == [(1, 3), (1, 4), (1, 4)] and all(q in (1, None) for q, _ in hits)
    empty = build_index(docs.limit(0), ["id"], ["seq"])
    assert top_k(empty, queries)[0].count() == 0
    assert top_k(build_index(docs, ["id"], ["seq"]), queries.limit(0))[0].count() == 0


def test_postings_are_not_shuffled_and_tokens_do_not_stay(spark):
    import os

    from brandlens.session import ensure_checkpoint_dir

    where = ensure_checkpoint_dir(spark).removeprefix("file:")
    rows, _ = corpus(3, 300)
    before = set(os.listdir(where))
    index = build_index(spark.createDataFrame(rows, "id long, text string"), ["id"], ["id"], block=16)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(where)) - before}
    assert left == {"index-numbers", "index-blocks", "index-terms"}
    held = index.blocks.select(F.inline("postings")).agg(F.count("*"), F.min("doc"), F.max("doc")).first()
    assert held[0] == sum(len(set(tokenise_py(t))) for _, t in rows) and held[1] >= 1 and held[2] <= 300
