"""Streams with state of their own for each key (RocksDB, one value a key).

* G1 `seen_stream`: first arrivals only, by keys remembered for a time to live that counts from
  their first arrival (processing time). The state is bounded by the keys of that time; a row is
  never too late, whatever its event time, so no first arrival is lost.
* G3, A7, R6 `statistics_stream`: changes of the corpus statistics. The state holds what each
  document last counted for; a newer version of a document takes the old version's terms back.
  `append_statistics` sums the changes of a micro-batch by term and writes them under (run,
  batch). Statistics as of a batch are the sum of the changes up to it, so they are read at any
  version, and a micro-batch costs as much as the rows in it.

Streams with this state are started with `run_with_state`, which selects the state store.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import STOP_WORDS
from ..functions.text import tokenise
from .runs import query_id, run_available_now

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # small stores are opened without preallocated files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # with a time to live Spark would run batches without data for ever; what is over is also
    # left out when it is looked up, and goes for good with the next batch of data
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
WEEK_MS = 7 * 24 * 3600 * 1000


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The settings of `STORE` while a stream starts; it keeps them in its checkpoint."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_with_state(df: DataFrame, checkpoint: str, sink: Callable | str, mode: str = "append") -> StreamingQuery:
    """`run_available_now` for a stream of this module."""
    with state_store(df.sparkSession):
        return run_available_now(df, checkpoint, sink, mode)


def first_arrivals(order: str, ttl_ms: int) -> Callable:
    """The first row of each key, and none for as long as the key is remembered."""

    def first_of(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        if state.exists:
            (until,) = state.get
            if now < until:
                state.setTimeoutDuration(until - now)
                return
        first = None
        for some in rows:  # a key's rows come in bounded parts
            if len(some):
                best = some if len(some) == 1 else some.loc[[some[order].idxmin()]]
                if first is None or best[order].iloc[0] < first[order].iloc[0]:
                    first = best
        if first is not None:
            state.update((now + ttl_ms,))
            state.setTimeoutDuration(ttl_ms)
            yield first

    return first_of


def seen_stream(stream: DataFrame, keys: Sequence[str] = ("platform", "id"), order: str = "seq",
                ttl_ms: int = WEEK_MS) -> DataFrame:
    """G1: rows of `stream` whose keys did not arrive within the time to live; of several in one
    micro-batch the first in `order` (never null)."""
    return stream.groupBy(*keys).applyInPandasWithState(
        first_arrivals(order, ttl_ms), stream.schema, "until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


CHANGES = "term string, df long, n long, len long"


def document_terms(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The terms of a document's newest version, those of the version it replaces, and the
    changes of the number of documents and of their length: one row a document."""
    new = None
    for some in rows:
        if len(some):
            at = some["seq"].argmax() if len(some) > 1 else 0
            if new is None or some["seq"].iat[at] > new[0]:
                new = int(some["seq"].iat[at]), int(some["len"].iat[at]), some["terms"].iat[at]
    old = state.get if state.exists else None
    if new is None or (old is not None and old[0] >= new[0]):
        return  # an older version that arrives late changes nothing
    state.update(new)
    yield pd.DataFrame({"terms": [new[2]], "before": [old[2] if old else ""], "n": [0 if old else 1],
                        "len": [new[1] - (old[1] if old else 0)]})


def statistics_stream(stream: DataFrame, text: Column, keys: Sequence[str] = ("platform", "id"),
                      order: str = "seq", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Signed changes (term, df, n, len) of the corpus statistics; rows without a term carry the
    changes of the number of documents and of their length in tokens."""
    tok = stream.select(*keys, F.col(order).cast("long").alias("seq"), tokenise(text, stop_words).alias("tok"))
    # tokens hold no white space
    docs = tok.select(*keys, "seq", F.size("tok").cast("long").alias("len"),
                      F.array_join(F.array_distinct("tok"), " ").alias("terms"))
    each = docs.groupBy(*keys).applyInPandasWithState(
        document_terms, "terms string, before string, n long, len long", "seq long, len long, terms string",
        "append", GroupStateTimeout.NoTimeout)
    # terms of one version only count, by expressions: Python sees one row a document
    now, before = (F.filter(F.split(c, " "), lambda t: t != "") for c in ("terms", "before"))

    def changes(terms: Column, df: int) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(df).cast("long").alias("df"),
                                                     F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("len")))

    size = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), "n", "len"))
    return each.select(F.inline_outer(F.concat(changes(F.array_except(now, before), 1),
                                         changes(F.array_except(before, now), -1), size)))


def append_statistics(path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: the changes of each micro-batch, summed by term. A replayed batch
    overwrites what it wrote before."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch.sparkSession, checkpoint)
        (batch.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "len")])
         .filter("df <> 0 OR n <> 0 OR len <> 0")
         .withColumn("_run", F.lit(run)).withColumn("_batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_run", "_batch").parquet(path))

    return fn


def statistics(spark: SparkSession, path: str, checkpoint: str, version: int | None = None) -> DataFrame:
    """term, df, n (documents) and len (tokens) summed over the batches of the run that
    `checkpoint` belongs to, up to batch `version` if given. The row without a term has n and len."""
    rows = spark.read.schema(f"{CHANGES}, _run string, _batch long").parquet(path)
    rows = rows.where(F.col("_run") == query_id(spark, checkpoint))
    if version is not None:
        rows = rows.where(F.col("_batch") <= version)
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "len")])


def document_frequencies(stats: DataFrame) -> DataFrame:
    """term and df of the terms that any current document holds."""
    return stats.where("term IS NOT NULL AND df > 0").select("term", "df")


def corpus_size(stats: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return stats.where("term IS NULL").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("len") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("avgdl"))


def query_statistics(stats: DataFrame, terms: Sequence[str]) -> dict:
    """n, avgdl and the document frequency of each of the given terms, for `bm25_scores`."""
    size = corpus_size(stats).first()
    found = {r["term"]: float(r["df"]) for r in document_frequencies(stats).where(F.col("term").isin(list(terms))).collect()}
    return {"n": float(size["n"]), "avgdl": size["avgdl"], "df": found}
