"""Language identification by Bloom filters whose slots are bitmasks of languages.

Method. N-grams of bytes (lower case, blanks at both ends) are counted per language in a
bounded sample. A language holds an n-gram if its share there is not far below its largest
share in any language, so that quotations in another language do not count. Held n-grams go
into one bit-sliced Bloom filter: a slot is a bitmask with one bit per language, a look-up
ands the slots of an n-gram and returns all languages that contain it at once. Bits are
counted per language over the whole text, the share that a filter of that fill answers
wrongly is taken off, and the largest corrected count decides. Beyond 64 languages further
filters hold 64 languages each.

Defined cases: null text and text without a letter give `und` with score 0; of equal counts
the language with more sample rows wins, then the first by name; rows are decided one by
one, so repeated rows and null ids pass through; without any language in the learning rows
every row gives `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, crc_remainder, documents, table
from .ngrams import Texts, labelled_sample, pieces, sums

by_value(__name__)

ORDERS = (3, 4, 5)
#: Documents of each language that the filters may be learned from.
PER_LANGUAGE = 1500
#: Occurrences below this in a language's sample are left out.
LEAST = 3
#: A language holds an n-gram if its share is at least this part of the largest share.
PART = 0.3
SLOT_BITS = 22
HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
UNKNOWN = "und"


def slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one array per hash function."""
    for k in HASHES:
        yield (grams * np.uint32(k)) >> np.uint32(32 - SLOT_BITS)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, gram, n for each slice of labelled texts."""
    for batch in batches:
        for piece in pieces(batch):
            texts, label = Texts(piece["text"]), piece["label"].dictionary_encode()
            codes = label.indices.to_numpy()
            for n, h in texts.grams(ORDERS):
                first, last = texts.range_of(n)
                for code, name in enumerate(label.dictionary.to_pylist()):
                    own = [h[a:b] for a, b in zip(first[codes == code], last[codes == code], strict=True)]
                    gram, count = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)),
                         pa.array(count.astype(np.int64))], ["label", "gram", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Learn names, filters and false-positive rates from rows with crc32(doc_id) mod 4 <> 2."""
    sample = labelled_sample(docs, docs, "lang", 4, 2, per_language)
    counts = (sample.mapInArrow(gram_counts, "label string, gram long, n long")
              .groupBy("label", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST))
    share = F.col("n") / F.sum("n").over(W.partitionBy("label"))
    held = (counts.withColumn("share", share)
            .withColumn("most", F.max("share").over(W.partitionBy("gram")))
            .filter(F.col("share") >= PART * F.col("most")).select("label", "gram").toPandas())
    sizes = sample.groupBy("label").count().collect()
    names = [r["label"] for r in sorted(sizes, key=lambda r: (-r["count"], r["label"]))]
    filters, wrong = [], []
    for block in range(0, len(names), 64):
        some = names[block:block + 64]
        width = next(w for w in (8, 16, 32, 64) if len(some) <= w)
        kind = np.dtype(f"u{width // 8}").type
        masks = np.zeros(1 << SLOT_BITS, kind)
        for bit, name in enumerate(some):
            grams = held.loc[held["label"] == name, "gram"].to_numpy().astype(np.uint32)
            own = np.zeros(1 << SLOT_BITS, bool)
            for at in slots(grams):
                own[at] = True
            masks[own] |= kind(1 << bit)
            wrong.append(own.mean() ** len(HASHES))
        filters.append(masks)
    return {"names": names, "filters": filters, "wrong": np.array(wrong)}


def decide(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    names, wrong = np.array([*model["names"], UNKNOWN]), model["wrong"]
    hashed = Texts(texts)
    found, total = np.zeros((len(wrong), len(texts))), np.zeros(len(texts))
    for n, h in hashed.grams(ORDERS):
        first, last = hashed.range_of(n)
        total += last - first
        for block, masks in enumerate(model["filters"]):
            mask = np.bitwise_and.reduce([masks[at] for at in slots(h)])
            for bit in range(64 * block, min(64 * block + 64, len(wrong))):
                has = (mask & mask.dtype.type(1 << (bit - 64 * block))) != 0
                found[bit] += sums(has, first, last)
    letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
    if not len(wrong):
        return np.full(len(texts), UNKNOWN), np.zeros(len(texts))
    share = np.clip((found / np.maximum(total, 1) - wrong[:, None]) / np.maximum(1 - wrong[:, None], 1e-9), 0, 1)
    return (names[np.where(letters, share.argmax(0), len(wrong))], np.where(letters, share.max(0), 0.0))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^22 slots per 64 languages

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                names, score = decide(piece["text"], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(names.tolist(), pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"])

    return documents(docs).mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known: not those that are
    null, have no letter, or share no n-gram with any language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                names, score = decide(pc.fill_null(piece["text"], ""), shared.value)
                yield piece.filter(pa.array((names != UNKNOWN) & (score > 0)))

    return docs.mapInArrow(known, docs.schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
