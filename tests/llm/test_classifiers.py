"""Quality, toxicity and language: held-out accuracy and defined cases."""

import random

import pytest

from brandlens.llm import language, quality, toxicity
from brandlens.llm.common import crc_remainder

WORDS = {"en": "the of and that with this from have were which".split(),
         "fr": "le la les des une dans pour avec sur est".split(),
         "de": "der die das und nicht mit ein auf ist zu".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobians"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, int(good), int(toxic)))
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    return made.repartition(4).cache()


def accuracy(rows, corpus, label, predict):
    truth = {r.doc_id: r[label] for r in corpus.collect()}
    return sum(predict(r) == truth[r.doc_id] for r in rows) / len(rows)


@pytest.mark.parametrize("module, label, threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(corpus, module, label, threshold):
    model = module.fit(corpus.select("doc_id", "text"), corpus.select("doc_id", label))
    rows = module.score(corpus, model).filter(crc_remainder("doc_id", 5) == 0).collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, corpus, label, lambda r: int(r.score >= threshold)) > 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_read(corpus, module, label):
    """Turning the held-out labels round changes no score."""
    from pyspark.sql import functions as F

    held = crc_remainder("doc_id", 5) == 0
    labels = corpus.select("doc_id", label)
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = (module.score(corpus, module.fit(corpus, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_missing_labels(spark, corpus, odd_docs, texts, no_docs, module, label):
    labels = corpus.select("doc_id", label)
    rows = module.score(odd_docs, module.fit(corpus, labels)).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in texts), key=repr)
    assert all(0 <= r.score <= 1 for r in rows)
    assert module.score(no_docs, module.fit(corpus, labels)).collect() == []
    none = spark.createDataFrame([(None, 1), (3, None)], f"doc_id long, {label} int")
    assert all(0 <= r.score <= 1 for r in module.score(odd_docs, module.fit(odd_docs, none)).collect())


def test_language(corpus):
    rows = language.predict(corpus, language.fit(corpus)).filter(crc_remainder("doc_id", 4) == 2).collect()
    assert len(rows) > 50 and accuracy(rows, corpus, "lang", lambda r: r.lang_pred) > 0.98


def test_language_of_odd_rows(spark, corpus, odd_docs, texts, no_docs):
    model = language.fit(corpus)
    rows = language.predict(odd_docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 7, 8):  # null, empty, blanks, no letter
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in WORDS
    assert language.predict(no_docs, model).collect() == []
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(odd_docs, nothing).collect()} == {"und"}
    kept = language.with_language(odd_docs, model)
    assert kept.columns == odd_docs.columns and {3, 4, 7, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_more_than_64_languages(spark):
    rng = random.Random(1)
    rows = []
    for k in range(70):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)]
        rows += [(k * 20 + j, " ".join(rng.choices(words, k=20)), f"l{k:02}") for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model["names"]) == 70 and len(model["filters"]) == 2
    truth = {r[0]: r[2] for r in rows}
    found = language.predict(docs, model).collect()
    assert sum(truth[r.doc_id] == r.lang_pred for r in found) / len(found) > 0.97


def test_toxicity_of_words_that_run_through_a_text(spark):
    """A word that many clean texts quote once, and toxic ones use throughout; scores follow from
    the weights by a plain loop."""
    import math
    from collections import Counter

    import numpy as np

    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = [rng.choice(WORDS["de"]) for _ in range(40)]
        toxic = rng.random() < 0.2
        for _ in range(6 if toxic else rng.random() < 0.3):
            words.insert(rng.randrange(len(words)), "grobian")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    weights, bias = toxicity.fit(docs, docs)
    found = {r.doc_id: r.score for r in toxicity.score(docs, (weights, bias)).collect()}
    assert sum((found[i] >= 0.5) == bool(t) for i, _, t in rows) >= 0.99 * len(rows)

    def plain(text):
        data, counts = f" {text} ".encode(), Counter()
        for n in toxicity.ORDERS:
            for k in range(len(data) - n + 1):
                h = 0
                for b in data[k:k + n]:
                    h = (h * 0x01000193 + b) & 0xFFFFFFFF
                x = ((h + n) * 0x9E3779B1) & 0xFFFFFFFF
                counts[(x ^ (x >> 15)) >> (32 - toxicity.BITS)] += 1
        z = bias + sum(weights[b] * math.log2(1 + c) for b, c in counts.items())
        return 1 / (1 + math.exp(-z))

    for i, text, _ in rows[:40]:
        assert np.isclose(found[i], plain(text), atol=1e-9)


def test_minimum_of_a_known_function():
    import numpy as np

    a = np.diag([1.0, 10.0, 100.0]) + 0.1
    b = np.array([1.0, -2.0, 3.0])
    x, left = toxicity.minimise(lambda w: (float(w @ a @ w / 2 - b @ w), a @ w - b), np.zeros(3))
    assert left <= toxicity.FLAT and np.allclose(x, np.linalg.solve(a, b), atol=1e-6)


def test_sample_is_bounded_and_does_not_follow_storage(spark):
    from brandlens.llm.ngrams import labelled_sample

    rows = [(i, f"text {i}", "a" if i % 10 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [sorted(map(tuple, labelled_sample(x, x, "lang", 4, 2, 150).collect())) for x in (docs, docs.repartition(7))]
    assert found[0] == found[1]
    assert [sum(lang == k for _, lang in found[0]) for k in "ab"] == [150, 150]
