"""Quality classifier: supervised subword embeddings.

Method. Words, pairs of words and the byte n-grams inside and around them are hashed to buckets, each with
a learned vector. A document is the average of the vectors of all its features, a softmax
layer gives the probability of each label. Vectors and layer are learned together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.

At scoring time the product of a bucket's vector and the layer is taken once per bucket
(the average and the product commute), so a document costs one look-up per feature.

Defined cases: a null or empty text has no feature but its padding and gets the score of
the layer's bias; rows are scored one by one, so repeated rows and null ids pass through; an
empty label table (or one with a single label) gives the share of label 1 (0.5 without
labels) to every row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, crc_remainder, documents, table
from .ngrams import Texts, labelled_sample, pieces, sums

by_value(__name__)

ORDERS = (3, 4, 5)
BITS = 18
DIM = 16
#: Labelled documents of each label that the fit may use.
PER_CLASS = 2000
EPOCHS = 8
RATE = 4.0
THRESHOLD = 0.3


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, range of each text) for words, word pairs and every order of byte n-grams."""
    h, first, last = texts.words()
    yield h >> np.uint32(32 - BITS), first, last
    # word pairs by the difference of their hashes, so that all repeated words share a bucket
    pair = (h[:-1] - h[1:]) * np.uint32(0x85EBCA6B)
    yield pair >> np.uint32(32 - BITS), first, np.maximum(last - 1, first)
    for n, h in texts.grams(ORDERS):
        yield (h >> np.uint32(32 - BITS), *texts.range_of(n))


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of each text and their shares of all its features."""
    for batch in batches:
        for piece in pieces(batch):
            found = list(features(Texts(piece["text"])))
            rows = []
            for i in range(piece.num_rows):
                own = np.concatenate([x[a[i]:b[i]] for x, a, b in found])
                bucket, n = np.unique(own, return_counts=True)
                rows.append((bucket.astype("<u4").tobytes(), (n / max(1, len(own))).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [piece["label"].cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())], ["label", "buckets", "shares"])


def train(rows: list, prior: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit of each bucket, and the bias, from (label, buckets, shares) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    label = np.array([r[0] for r in rows], np.int64)
    seen = np.bincount(label, minlength=2)
    if len(rows) == 0 or (seen == 0).any():
        return np.zeros(1 << BITS, np.float32), float(np.log((prior[1] + 1e-9) / (prior[0] + 1e-9)))
    weight = prior / (seen / len(rows))  # the sample may not have the labels' shares
    data = [(np.frombuffer(b, "<u4"), np.frombuffer(s, "<f4")) for _, b, s in rows]
    step, steps = 0, EPOCHS * len(data)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, share = data[i]
            own = vectors[at]
            mean = share @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            g = (p * weight[label[i]]).astype(np.float32)
            back = g @ layer
            layer -= 0.1 * rate * np.outer(g, mean)
            bias -= 0.01 * rate * g
            # shares are small: they are scaled by the document's number of distinct buckets
            vectors[at] = own - rate * np.outer(share * np.float32(len(at) ** 0.5), back)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0."""
    sample = labelled_sample(docs, labels, "quality", 5, 0, per_class)
    rows = (sample.mapInArrow(bags, "label int, buckets binary, shares binary").toPandas()
            .sort_values(["label", "buckets"], kind="stable"))
    usable = labels.filter(F.col("quality").isNotNull() & (crc_remainder("doc_id", 5) != 0))
    n, ones = usable.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = np.array([n - ones, ones]) / n if n else np.array([0.5, 0.5])
    return train(list(rows.itertuples(index=False, name=None)), prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit, bias = shared.value
        for batch in batches:
            for piece in pieces(batch):
                total, n = np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                for bucket, first, last in features(Texts(piece["text"])):
                    total += sums(logit[bucket], first, last)
                    n += last - first
                z = np.clip(total / np.maximum(n, 1) + bias, -60, 60)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return documents(docs).mapInArrow(scored, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
