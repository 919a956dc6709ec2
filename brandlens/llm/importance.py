"""Importance resampling towards a target distribution, drawn by weighted median-of-medians.

Method. Words and runs of words are hashed into buckets, and bucket counts of the raw corpus and
of the target texts give each bucket a gain (the rounded log ratio of its shares). The gains are
one array, and a document's weight is the mean of the array's values at its features' buckets.
A Gumbel term from a hash of the id turns the draw without replacement into a choice of the
largest scores. The cutoff is found by weighted median of medians: each partition names the
median of its keys that are still open, the median of these medians weighted by the sizes is
tried, and the side that cannot hold the cutoff is discarded, at least a quarter of the open
keys, until so few are left that they are sorted at once. Keys are (score, id, row number),
so the cutoff is exact and unique. The winners are ranked by a range partition.

A round reads 32 bytes a row and sends one row a partition to the driver; texts are read twice,
for the counts and for the weights, and never shuffled.

Defined cases: a null or empty text has no features, weight 0 and too few words to be drawn; a
null id counts as empty text in the hash and comes last among equal scores; repeated rows are
rows of their own and may be drawn together; without target texts all counts of the target are
0; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.operators.reports import global_rank

from .common import by_value, documents, materialise, table
from .exact_dedup import folded

by_value(__name__)

#: Words are what stands between these characters, after A-Z are made small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: With so few keys left the cutoff is looked up among them on the driver.
LAST_KEYS = 50_000
#: Keys of a partition that are sorted together.
CHUNK = 1 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(folded(text), BETWEEN, -1), lambda w: w != "")


def features(word: Column, run: int) -> Column:
    """All runs of 1 to `run` consecutive words, joined by a blank."""

    def runs(n: int) -> Column:
        starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1))), F.lit(1),
                         F.greatest(F.size(word) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda i: F.array_join(F.slice(word, i, n), " "))

    return F.concat(word, *[runs(n) for n in range(2, run + 1)]) if run > 1 else word


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(rows: DataFrame, run: int, buckets: int) -> dict[int, int]:
    """How many features of all texts fall into each bucket; one number a bucket."""
    found = (rows.select(F.explode(features(words(F.col("text")), run)).alias("feature"))
             .groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n")))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket."""
    n_corpus, n_target = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (n_corpus + buckets))
                                       / float((corpus.get(b, 0) + 1) * (n_target + buckets))))
            for b in range(buckets)]


def floor_mean(total: Column, n: Column) -> Column:
    """total / n, rounded down."""
    return ((total - F.pmod(total, n)) / n).cast("long")


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED,
           least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, and eligible: whether the row has words enough to be drawn."""
    rows = documents(docs)
    texts = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, run, buckets), bucket_counts(texts, run, buckets), buckets)
    values = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one array
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
                           1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return (rows.select("doc_id", words(F.col("text")).alias("word"))
            .select("doc_id", F.size("word").alias("n_words"), features(F.col("word"), run).alias("feature"))
            .select("doc_id", "n_words", F.size("feature").cast("long").alias("n_features"),
                    F.aggregate("feature", F.lit(0).cast("long"),
                                lambda a, f: a + F.get(values, bucket(f, buckets))).alias("total"))
            .withColumn("weight", floor_mean(F.col("total"), F.greatest("n_features", F.lit(1).cast("long"))))
            .select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"),
                    (F.col("n_words") >= least_words).alias("eligible")))


# ---- selection --------------------------------------------------------------------------


def key_columns() -> list[Column]:
    """The order of the draw, smallest first, as four numbers."""
    return [(-F.col("score")).alias("a"), F.col("doc_id").isNull().cast("long").alias("b"),
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("c"), F.col("row").alias("d")]


def key_literal(key: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(key, "abcd", strict=True)])


def median(keys: np.ndarray) -> list[int] | None:
    """The lower median of sorted keys."""
    return keys[(len(keys) - 1) // 2].tolist() if len(keys) else None


def halves(keys: DataFrame, trial: tuple | None, chunk: int) -> list:
    """For each run of at most `chunk` keys of a partition: how many are up to `trial` and how
    many beyond it, and the median key of either side. Without a trial all count as beyond."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def described(parts: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate(parts)
            own = own[np.lexsort(own.T[::-1])]
            low = 0
            if trial is not None:
                before, tied = np.zeros(len(own), bool), np.ones(len(own), bool)
                for column, value in zip(own.T, trial, strict=True):
                    before |= tied & (column < value)
                    tied &= column == value
                low = int((before | tied).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([low]), pa.array([len(own) - low]),
                 pa.array([median(own[:low])], pa.list_(pa.int64())),
                 pa.array([median(own[low:])], pa.list_(pa.int64()))], ["n_low", "n_high", "low", "high"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch[c].to_numpy() for c in "abcd"], 1))
                size += batch.num_rows
            if size >= chunk:
                yield described(held)
                held, size = [], 0
        if held:
            yield described(held)

    return keys.mapInArrow(split, "n_low long, n_high long, low array<long>, high array<long>").collect()


def weighted_median(medians: list[tuple[list[int], int]]) -> tuple:
    """The median of the keys, each counted as often as its weight says."""
    ordered, seen = sorted((tuple(k), n) for k, n in medians), 0
    half = sum(n for _, n in ordered) / 2
    for key, n in ordered:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, drawn: int, last_keys: int = LAST_KEYS, chunk: int = CHUNK) -> tuple | None:
    """The key of rank `drawn` (from 1) among `keys` (a, b, c, d), all different."""
    key, open_keys = F.struct("a", "b", "c", "d"), keys
    found = halves(keys, None, chunk)
    left, medians = sum(r["n_high"] for r in found), [(r["high"], r["n_high"]) for r in found if r["high"]]
    if not 1 <= drawn <= left:
        return None
    low, high = None, None
    while left > last_keys:
        trial = weighted_median(medians)
        found = halves(open_keys, trial, chunk)
        upto = sum(r["n_low"] for r in found)
        if drawn <= upto:  # what lies beyond the trial is out
            side, left, high = "low", upto, trial
        else:
            side, left, low, drawn = "high", left - upto, trial, drawn - upto
        medians = [(r[side], r[f"n_{side}"]) for r in found if r[side]]
        open_keys = keys
        if low is not None:  # the first column again, as a filter that reaches the files
            open_keys = open_keys.filter(F.col("a") >= low[0]).filter(key > key_literal(low))
        if high is not None:
            open_keys = open_keys.filter(F.col("a") <= high[0]).filter(key <= key_literal(high))
    return sorted(tuple(r) for r in open_keys.collect())[drawn - 1]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, last_keys: int = LAST_KEYS,
             chunk: int = CHUNK, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`; of the rows that have
    words enough, the `percent` hundredths with the largest scores have a rank (from 1)."""
    rows = materialise(scored(docs, target, **options).withColumn("row", F.monotonically_increasing_id()), "draw-scored")
    keys = materialise(rows.filter("eligible").select(*key_columns()), "draw-keys")
    last = cutoff(keys, percent * keys.count() // 100, last_keys, chunk)
    key = F.struct(*key_columns())
    drawn = F.lit(False) if last is None else F.col("eligible") & (key <= key_literal(last))
    won = rows.filter(drawn).withColumn("key", key)
    out = ("doc_id", "n_features", "weight", "score")
    ranked = global_rank(won, [F.col("key")], "rank") if last is not None else won.withColumn("rank", F.lit(0).cast("long"))
    return ranked.select(*out, "rank").unionByName(
        rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents with words enough, drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
