"""Outputs: versioned records + meta envelope, alerts, word cloud, digest text.

Spark cannot overwrite a path it is reading, and a half-written output must never be
visible, so every write goes to a new version folder. A pointer file for the version is
added last and older pointers stay, so a reader always finds one: the newest it sees.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_if_exists


def _new_version() -> str:
    return uuid.uuid4().hex[:16]


def write_envelope(records: DataFrame, meta: DataFrame, out_dir: str,
                   partition_by: str = "platform") -> str:
    """Write records (Parquet, partitioned) and meta (JSON) as a new version; return it."""
    v = _new_version()
    base = out_dir.rstrip("/")
    records.write.mode("error").partitionBy(partition_by).parquet(f"{base}/records/{v}")
    meta.coalesce(1).write.mode("error").json(f"{base}/meta/{v}")
    spark = records.sparkSession
    pointer = spark.createDataFrame([(time.time_ns(), v)], "written long, version string")
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/pointers")
    return v


def current_version(spark: SparkSession, out_dir: str) -> str | None:
    pointers = read_if_exists(spark, f"{out_dir.rstrip('/')}/pointers")
    if pointers is None:
        return None
    return pointers.agg(F.max(F.struct("written", "version"))["version"]).first()[0]


def read_envelope(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame] | None:
    """(records, meta) of the current version, or None if nothing was written yet."""
    v = current_version(spark, out_dir)
    if v is None:
        return None
    base = out_dir.rstrip("/")
    return spark.read.parquet(f"{base}/records/{v}"), spark.read.json(f"{base}/meta/{v}")


def meta_row(records: DataFrame, flag: str = "is_critical") -> DataFrame:
    """One-row meta with maps: total, critical_count, by_platform, by_topic, by_sentiment."""
    from ..operators.rollups import meta_rollup

    has_label = "label" in records.columns
    long = meta_rollup(records, sentiment=has_label, flag=flag)

    def as_map(dim):
        sl = long.where(F.col("dimension") == dim)
        return sl.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(f"by_{dim}"))

    out = long.agg(F.max(F.when(F.col("dimension") == "total", F.col("n"))).alias("total"),
                   F.max(F.when(F.col("dimension") == "critical", F.col("n"))).alias("critical_count"))
    for d in ["platform", "topic"] + (["sentiment"] if has_label else []):
        m = as_map(d)
        out = out.withColumn(f"by_{d}", m.scalar())
    return out.withColumn("last_updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").json(path)


def write_word_cloud(cloud: DataFrame, path: str) -> None:
    cloud.select("word", "count").coalesce(1).write.mode("overwrite").json(path)


def write_digest(digest: DataFrame, path: str) -> None:
    """`digest` has one row with a `text` column (see reports.digest_text)."""
    digest.select("text").coalesce(1).write.mode("overwrite").text(path)
