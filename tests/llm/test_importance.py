"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from brandlens.llm import importance as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text, run, n):
    words = WORD.findall((text or "").translate(SMALL))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % n for k in range(1, run + 1)
                        for i in range(len(words) - k + 1)]


def plain(docs, target, run=1, n=10_000, least=20, percent=10):
    own = [(i, *buckets(t, run, n)) for i, t in docs]
    s = Counter(b for _, _, found in own for b in found)
    t = Counter(b for text in target for b in buckets(text, run, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in range(n)]
    rows = []
    for i, words, found in own:
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, [r[:4] for r in able[:percent * len(able) // 100]]


def corpus(n=700):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdefgéЯ日1", k=4)) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(45))).upper() if i % 5 else "x'y-z " * 12) for i in range(n)]
    docs += [(None, "word " * 30), (None, None), (n, ""), (n + 1, None), *docs[:40]]
    return docs, [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("run, last_keys, chunk", [(1, X.LAST_KEYS, X.CHUNK), (2, 8, 1 << 20), (3, 1, 16)])
def test_against_plain_version(spark, run, last_keys, chunk):
    """With few last keys the cutoff is reached by medians of medians alone."""
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, word string").repartition(6)
    rows = X.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run,
                      last_keys=last_keys, chunk=chunk).collect()
    every, drawn = plain(docs, target, run)
    assert sorted(((*r[:4],) for r in rows), key=repr) == sorted((r[:4] for r in every), key=repr)
    ranked = sorted((r for r in rows if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r[:4]) for r in ranked] == drawn


def test_cutoff_among_ties(spark):
    """The k-th key for every k, at heavily repeated first columns."""
    rng = random.Random(2)
    keys = [(rng.choice([-5, 0, 0, 0, 9]), rng.randrange(2), rng.randrange(4), d) for d in range(60)]
    df = spark.createDataFrame(keys, "a long, b long, c long, d long").repartition(5)
    for k in (1, 2, 17, 30, 59, 60):
        assert X.cutoff(df, k, last_keys=1, chunk=8) == sorted(keys)[k - 1]
    assert X.cutoff(df, 0) is None and X.cutoff(df.limit(0), 1) is None


def test_empty_tables_and_odd_rows(spark, odd_docs, no_docs, texts):
    target = spark.createDataFrame([], "item_id long, text string")
    assert X.resample(no_docs, target).collect() == []
    rows = X.resample(odd_docs, target).collect()
    assert sorted((tuple(r[:4]) for r in rows), key=repr) == sorted((r[:4] for r in plain(texts, [])[0]), key=repr)
    assert [r.rank for r in rows if r.rank is not None] == []  # a tenth of the one row with words enough
