import random

import pyarrow as pa
import pytest

from brandlens.llm import contamination as X
from brandlens.llm.ngrams import WORD_BYTES, Texts

rng = random.Random(2)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(500)]


def passage(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[at] = "changed"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, "added")
    return words


def brute(texts, items):
    batch = Texts(pa.array(texts, pa.string()), WORD_BYTES)
    h, first, last = batch.words()
    own = X.item_words(items)
    found = {}
    for d in range(len(texts)):
        for i, item in enumerate(own):
            if len(item) and last[d] > first[d]:
                distance, _ = X.distance(item, h[first[d]:last[d]])
                if distance <= X.edits(len(item)):
                    found[d, i] = distance
    return found


def test_recall_against_brute_force(spark):
    items = [" ".join(passage(rng.randrange(6, 60))) for _ in range(60)]
    texts = []
    for item in items:
        for share in (0, 0.1, 0.2):
            words = item.split()
            texts.append(" ".join(passage(30) + edited(words, int(len(words) * share)) + passage(30)))
    texts += [" ".join(passage(80)) for _ in range(40)]
    expected = brute(texts, items)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in X.contaminated(docs, benchmark).collect()}
    assert set(found) <= set(expected)
    assert all(found[k] >= expected[k] for k in found)
    assert len(found) >= 0.95 * len(expected) > 150
    exact = {k for k, d in expected.items() if d == 0}
    assert exact <= set(found)
    stays = X.clean_rows(docs, benchmark)
    assert stays.columns == docs.columns
    assert {r.doc_id for r in stays.collect()} == set(range(len(texts))) - {d for d, _ in found}


@pytest.mark.parametrize("n", [*range(5, 26), 40, 59])
def test_no_passage_is_missed_at_most_edits(n):
    """Every length by itself, with one substitution at each word and with all allowed edits."""
    items = [" ".join(passage(n)) for _ in range(12)]
    texts = []
    for item in items:
        words = item.split()
        for at in range(n):
            texts.append(" ".join(passage(10) + words[:at] + ["changed"] + words[at + 1:] + passage(10)))
        texts += [" ".join(passage(10) + edited(words, X.edits(n)) + passage(10)) for _ in range(10)]
        # edits dealt evenly leave the shortest pieces
        spread = {round((k + 0.5) * n / X.edits(n)) for k in range(X.edits(n))}
        texts.append(" ".join(passage(10) + ["changed" if k in spread else w for k, w in enumerate(words)]))
    expected = brute(texts, items)
    own, words = X.item_words(items), Texts(pa.array(texts, pa.string()), WORD_BYTES).words()
    found = X.matches(X.Index(own, exact=True), *words)
    assert {(t, i): d for t, i, d, _, _ in found} == expected
    assert len(expected) >= len(texts)
    # walks with bit sampling alone, as the query has it
    index = X.Index(own)
    assert len(index.tables) == 1
    walked = {(t, i): d for t, i, d, _, _ in X.matches(index, *words)}
    assert walked.items() <= expected.items()
    assert len(walked) >= 0.98 * len(expected)


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 11, 15, 19, 25, 40, 59])
def test_recall_of_walks_at_all_allowed_edits(n):
    items = [" ".join(passage(n)) for _ in range(40)]
    texts = [" ".join(passage(10) + edited(item.split(), X.edits(n)) + passage(10)) for item in items for _ in range(8)]
    expected = brute(texts, items)
    found = X.matches(X.Index(X.item_words(items)), *Texts(pa.array(texts, pa.string()), WORD_BYTES).words())
    assert len(expected) >= len(texts)
    assert len({(t, i) for t, i, *_ in found} & expected.keys()) >= 0.95 * len(expected)
    assert {(t, i) for t, i, *_ in found} <= expected.keys()


@pytest.mark.parametrize("text, hit", [
    ("The cat sat on the mat.", True), ("so THE cat,sat on\nthe mat!", True), ("the cat sat on the", True),
    ("the cat sat", False), ("", False), (None, False)])
def test_small_items_and_signs(spark, text, hit):
    docs = spark.createDataFrame([(None, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "the cat sat on the mat"), (8, None), (9, "")], "item_id long, text string")
    assert [r.item_id for r in X.contaminated(docs, benchmark).collect()] == ([7] if hit else [])


def test_passages_do_not_reach_into_the_next_text(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert X.contaminated(docs, benchmark).collect() == []


def test_odd_rows_blocks_of_items_and_empty_tables(spark, odd_docs, no_docs, texts, monkeypatch):
    monkeypatch.setattr(X, "ITEMS", 1)
    some = texts[-1][1].split()[20_000:20_030]
    benchmark = spark.createDataFrame([(1, " ".join(some)), (2, "a text without an id but with words"),
                                       (2, "a text without an id but with words")], "item_id long, text string")
    found = X.contaminated(odd_docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == [(11, 1), (None, 2), (None, 2)]
    assert X.contaminated(no_docs, benchmark).collect() == []
    assert X.contaminated(odd_docs, benchmark.limit(0)).collect() == []
