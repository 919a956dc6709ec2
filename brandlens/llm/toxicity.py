"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Method. A document is its hashed byte n-grams (in lower case, with a blank at both ends) with
their counts. In a bounded sample of labelled rows each n-gram gets the naive Bayes log-count
ratio of its share in toxic and in other documents; its value in a document is that ratio times
the logarithm of one more than its count, so that a word that every text may quote once weighs
less than one that runs through a text. A logistic regression on these values is fitted by
L-BFGS in numpy until the gradient has vanished, its rows weighted back to the labels' true
shares. A document's score is the logistic function of the sum over its distinct n-grams.

Defined cases: a null or empty text has no n-gram and gets the score of the bias; rows are
scored one by one, so repeated rows and null ids pass through; without labels (or with a
single label) every row gets the share of label 1, 0 if there are none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, crc_remainder, documents, table
from .ngrams import Texts, labelled_sample, pieces

by_value(__name__)

ORDERS = (4, 5, 6)
BITS = 20
#: Labelled documents of each label that the fit may use.
PER_CLASS = 1500
#: An n-gram in fewer sample documents has no weight.
LEAST = 4
#: An n-gram with a smaller log ratio, either way, has no weight.
LEAST_RATIO = 1.0
RIDGE = 1e-5
#: The fit ends when no part of the gradient is larger, or after so many steps.
FLAT = 1e-6
STEPS = 2000
#: Steps that L-BFGS remembers.
REMEMBERED = 10
THRESHOLD = 0.5


def present(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value without its ratio) of the distinct n-grams of all texts, by text."""
    keys = []
    for n, h in texts.grams(ORDERS):
        first, last = texts.range_of(n)
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        kind = np.uint32 if len(first) < 1 << (32 - BITS) else np.uint64
        number = np.repeat(np.arange(len(first), dtype=kind), count)
        keys.append((number << kind(BITS)) | (h[at] >> np.uint32(32 - BITS)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    value = np.log2(1 + np.diff(np.append(starts, len(key))))
    key = key[starts]
    return ((key >> key.dtype.type(BITS)).astype(np.int64), (key & key.dtype.type((1 << BITS) - 1)).astype(np.int64),
            value)


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The label, the distinct buckets and their values of each text."""
    for batch in batches:
        for piece in pieces(batch):
            number, bucket, value = present(Texts(piece["text"]))
            cut = np.searchsorted(number, np.arange(piece.num_rows + 1))
            bucket, value = bucket.astype("<u4"), value.astype("<f2")
            yield pa.RecordBatch.from_arrays(
                [piece["label"].cast(pa.int32()),
                 *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                   for x in (bucket, value))], ["label", "buckets", "values"])


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """The minimum of a smooth convex function by L-BFGS, and the largest part of its gradient there."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() <= FLAT:
            break
        way, shares = slope.copy(), []
        for s, y, rho in reversed(moves):
            share = rho * (s @ way)
            way -= share * y
            shares.append(share)
        if moves:
            s, y, _ = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), share in zip(moves, reversed(shares), strict=True):
            way += (share - rho * (y @ way)) * s
        step, fall = 1.0 if moves else min(1.0, 1 / np.abs(slope).sum()), slope @ way
        while True:
            new = x - step * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * step * fall or step < 1e-12:
                break
            step /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-20:
            moves = [*moves[-REMEMBERED + 1:], (s, y, 1 / (s @ y))]
        if step < 1e-12:
            break
        x, value, slope = new, new_value, new_slope
    return x, float(np.abs(slope).max())


def train(rows: list, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the bias, from (label, buckets, values) rows, which are used up."""
    label = np.array([r[0] for r in rows], np.int64)
    seen = np.bincount(label, minlength=2)
    weights = np.zeros(1 << BITS)
    if len(rows) == 0 or (seen == 0).any():
        return weights, float(np.log((prior[1] + 1e-9) / (prior[0] + 1e-9)))
    counts, holders = np.zeros((2, 1 << BITS)), np.zeros(1 << BITS, np.int64)
    for y, b, v in rows:
        bucket = np.frombuffer(b, "<u4")
        counts[y, bucket] += np.frombuffer(v, "<f2")
        holders[bucket] += 1
    share = (counts + 1) / (counts.sum(1, keepdims=True) + counts.shape[1])
    ratio = np.where(holders >= LEAST, np.log(share[1] / share[0]), 0.0)
    ratio[np.abs(ratio) < LEAST_RATIO] = 0.0
    # only n-grams with a ratio are held in memory together
    found = [(b, v) for b, v in ((np.frombuffer(b, "<u4"), np.frombuffer(v, "<f2")) for _, b, v in rows)]
    held = [ratio[b] != 0 for b, _ in found]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [int(h.sum()) for h in held])
    bucket = np.concatenate([b[h] for (b, _), h in zip(found, held, strict=True)])
    value = np.concatenate([v[h] for (_, v), h in zip(found, held, strict=True)])
    # columns that occur, numbered
    column, at = np.unique(bucket, return_inverse=True)
    x = (ratio[bucket] * value).astype(np.float32)
    weight = (prior / (seen / len(rows)))[label] / len(rows)
    sign = np.where(label == 1, 1.0, -1.0)
    n_rows = len(rows)
    rows.clear()  # the sample's memory goes before the fit needs its own
    del found, held, value, counts, share, holders
    ratio_of = ratio[column]
    del bucket, ratio

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (np.bincount(doc, x * w[at], n_rows) + w[-1])
        wrong = -sign * weight / (1 + np.exp(np.clip(z, -60, 60)))
        slope = np.append(np.bincount(at, x * wrong[doc], len(column)) + RIDGE * w[:-1], wrong.sum())
        return float((weight * np.logaddexp(0, -z)).sum() + RIDGE / 2 * (w[:-1] @ w[:-1])), slope

    start = np.append(np.zeros(len(column)), np.log(prior[1] / prior[0]))
    w, left = minimise(loss, start)
    if left > 100 * FLAT:
        raise RuntimeError(f"the fit has not converged: {left}")
    weights[column] = w[:-1] * ratio_of
    return weights, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0."""
    sample = labelled_sample(docs, labels, "toxic", 5, 0, per_class)
    rows = list(sample.mapInArrow(sets, "label int, buckets binary, values binary").toPandas()
                .sort_values(["label", "buckets"], kind="stable").itertuples(index=False, name=None))
    usable = labels.filter(F.col("toxic").isNotNull() & (crc_remainder("doc_id", 5) != 0))
    n, ones = usable.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = np.array([n - ones, ones]) / n if n else np.array([1.0, 0.0])
    return train(rows, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for piece in pieces(batch):
                number, bucket, value = present(Texts(piece["text"]))
                z = np.bincount(number, weights[bucket] * value, piece.num_rows) + bias
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    return documents(docs).mapInArrow(scored, "doc_id long, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
