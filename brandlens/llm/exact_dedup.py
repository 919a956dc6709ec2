"""Exact deduplication by a streaming query with disk-backed keyed state.

Method. Arriving rows are landed in a content store (text, content digest, locator). A
Structured Streaming query reads the narrow columns of the store and keeps one state row
per digest in RocksDB, without expiry: the identifier of the row that stays, the locator
of its content (landing and row number in the store) and how many rows carried the digest.
Rows are combined per task before they reach the state, so a group that holds a third of
all rows sends one row per task. A digest seen more than once is a hit: the full bytes of
all its rows are compared with the content at the kept locator, and where they differ (two
texts share a digest) the group is split by its exact bytes.

Defined cases: a null text counts as empty; a null id sorts below every other id; of rows
with equal text the largest id stays, of those with equal id too the last landed row;
repeated rows are rows of their own (exactly one row of a group is kept); an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import conf, materialise, scratch_dir, sized_broadcast, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Estimated bytes of one broadcast hit (digest text and locator).
HIT_BYTES = 200


def folded(text):
    """Lower-case A-Z only, as a column expression."""
    return F.translate(text, UPPER, UPPER.lower())


def sha256_folded(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes after lower-casing A-Z only."""
    return F.sha2(folded(text), 256)


def land(docs: DataFrame, store: str, digest: Callable[[Column], Column] = sha256_folded) -> str:
    """Append the rows of `docs` to the content store and return the landing's name.

    A stored row holds doc_id, text, row (its number in the landing), digest, and `rest`,
    the input row's columns other than the text.
    """
    landing = f"l{uuid.uuid4().hex}"

    rest = [F.col(c) for c in docs.columns if c != "text"]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                 F.col("text").cast("string").alias("text"),
                 F.struct(*rest).alias("rest"))
     .withColumn("row", F.monotonically_increasing_id())
     .withColumn("digest", digest(F.coalesce("text", F.lit(""))))
     .write.parquet(f"{store}/content/landing={landing}"))
    return landing


def advance(spark, store: str, files_per_batch: int = 1000) -> DataFrame:
    """Run the streaming query over what was landed since its last run; return the state:
    digest, keep (doc_id, landing, row), n (rows so far)."""
    with conf(spark,
              spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution"
              ".streaming.state.RocksDBStateStoreProvider",
              spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
              spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
              spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="128",
              # a store is closed when its batch is written, not when a later one needs the place
              spark__sql__streaming__stateStore__unloadOnCommit="true"):
        arrivals = (spark.readStream
                    .schema("doc_id long, row long, digest string, landing string")
                    .option("maxFilesPerTrigger", files_per_batch)
                    .parquet(f"{store}/content"))
        keyed = arrivals.groupBy("digest").agg(
            F.max(F.struct("doc_id", "landing", "row")).alias("keep"), F.count("*").alias("n"))
        query = (keyed.writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(f"{store}/state")
        return materialise(state.select(F.col("key.*"), F.col("value.*")).toDF("digest", "keep", "n"),
                           "dedup-state")


def decide(spark, store: str, state: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Check the bytes behind every hit and give each landed row its group.

    Returns landing, row, doc_id, digest, keep_id, group_size, kept and the stored columns
    named in `carry`.
    """
    content = spark.read.parquet(f"{store}/content")
    hits = state.filter("n > 1")
    n_hits = hits.count()
    bytes_of = folded(F.coalesce("text", F.lit("")))
    hit_rows = content.join(sized_broadcast(hits, n_hits, HIT_BYTES), "digest")
    # equal bytes collapse inside each task, so a large group sends one text per task
    variants = (hit_rows.select("digest", bytes_of.alias("folded"))
                .groupBy("digest", "folded").agg(F.count("*").alias("rows")))
    at_locator = (F.col("landing") == F.col("keep.landing")) & (F.col("row") == F.col("keep.row"))
    kept_bytes = hit_rows.filter(at_locator).select("digest", bytes_of.alias("kept_bytes"))
    clashes = materialise(variants.join(kept_bytes, "digest").filter("folded <> kept_bytes")
                          .select("digest").distinct(), "dedup-clash")

    rows = content.select("landing", "row", "doc_id", "digest", *carry)
    out = ["landing", "row", "doc_id", "digest",
           F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
           F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
           (F.col("keep").isNull() | at_locator).alias("kept"), *carry]
    if clashes.isEmpty():
        return rows.join(sized_broadcast(hits, n_hits, HIT_BYTES), "digest", "left").select(*out)
    # two texts under one digest: their rows are grouped by the bytes themselves
    split = (content.join(clashes, "digest")
             .select("landing", "row", "doc_id", "digest", bytes_of.alias("folded"), *carry))
    by_bytes = split.groupBy("digest", "folded").agg(
        F.max(F.struct("doc_id", "landing", "row")).alias("keep"), F.count("*").alias("n"))
    clean = rows.join(clashes, "digest", "left_anti").join(hits, "digest", "left")
    return clean.select(*out).unionByName(split.join(by_bytes, ["digest", "folded"]).select(*out))


def dedup(docs: DataFrame, store: str | None = None, digest: Callable[[Column], Column] = sha256_folded,
          files_per_batch: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Land `docs`, advance the state and return a decision for every row of the store.

    A later call with the same `store` continues from its state: rows landed before stay
    known for ever, and decisions cover all landings.
    """
    spark = docs.sparkSession
    store = store or scratch_dir(spark, "dedup-store")
    land(docs, store, digest)
    return decide(spark, store, advance(spark, store, files_per_batch), carry)


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    kept = dedup(docs, carry=("text", "rest")).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c)
                         for c in docs.columns])


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of `documents`: one row per document."""
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
