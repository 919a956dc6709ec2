import random

from pyspark.sql import functions as F

from brandlens.operators import spelling


def within_one(a, b):
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return None
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    same = a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]
    return 1 if same else None


def edited(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + "aé"[i % 2] + word[i:], word[:i] + "b" + word[i + 1:]])


def test_words_equal_a_scan(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.choice([1, 2, 3, 5, 8]))) for _ in range(150)}
    words |= {"".join(rng.choices("abcdef", k=size)) for size in (38, 39, 40, 41, 42, 90) for _ in range(4)}
    words |= {e for w in sorted(words) for e in (edited(rng, w), edited(rng, edited(rng, w) or "x")) if e}
    queries = sorted(words)[::2] + sorted(words)[:3]
    vocab = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n_docs long")
    asked = spark.createDataFrame([(q,) for q in queries] + [(None,), ("",)], "query string")
    found = {(r.query, r.word): r.distance for r in spelling.near_words(asked, vocab).collect()}
    expected = {(q, w): within_one(q, w) for q in set(queries) for w in words if within_one(q, w) is not None}
    assert found == expected and any(len(q) > 41 and q != w for q, w in found)


def test_hits_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Crash, crahs crash"), (2, "crashh here"), (3, None), (4, ""), (5, "x" * 60_000),
                                  (6, "cash")], "id long, text string")
    words = spelling.document_words(docs, F.col("text"), ["id"])
    asked = spark.createDataFrame([("crash",), ("CRASH",), ("x" * 59_999,)], "query string")
    near = spelling.near_words(asked, spelling.vocabulary(words))
    hits = sorted((r.query[:5], r.id, r.distance) for r in spelling.spelling_hits(words, near, ["id"]).collect())
    assert hits == [("crash", 1, 0), ("crash", 2, 1), ("crash", 6, 1), ("xxxxx", 5, 1)]
    assert spelling.spelling_hits(words.limit(0), near, ["id"]).count() == 0


def test_words_can_be_written_before_they_are_read(spark):
    docs = spark.createDataFrame([("a", "Red, red moss"), ("b", ""), ("c", None)], "id string, text string")
    written = docs.select("id", spelling.distinct_words(F.col("text")).alias("words"))
    got = sorted(map(tuple, spelling.document_words(written, "words", ["id"]).collect()))
    assert got == [("a", "moss"), ("a", "red")] == sorted(map(tuple, spelling.document_words(docs, F.col("text"), ["id"]).collect()))
