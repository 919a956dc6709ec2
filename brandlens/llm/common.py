"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.session import materialise, scratch_dir

__all__ = ["by_value", "materialise", "scratch_dir", "documents", "table", "conf", "sized_broadcast",
           "crc_remainder", "bounded_batches",
           "release_memory"]

#: A side is broadcast only when its counted rows times this estimate stay below the bound.
BROADCAST_BYTES = 32 << 20


def by_value(module: str) -> None:
    """Ship the functions of `module` to the workers by value, so that a cluster needs no
    installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def release_memory() -> None:
    """Give freed memory back to the system, which a worker would keep for its next task while
    the other processes of the machine need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Settings of the batches that travel to Python, with Spark's default and the value used here.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
           "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def bounded_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of at most 1,000 rows and about 8 MB (a longer row is a
    batch of its own) where the session has Spark's defaults, so that many long texts are never
    one batch. The setting stays, as the returned frames run later."""
    for key, (default, bounded) in BATCHES.items():
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, bounded)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id` (long) and `text` (null counts as empty), plus the columns named in `more`.

    Every other column is left out, so an operator's own column names never clash with
    columns of the input.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def sized_broadcast(side: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`side` with a broadcast hint if `rows * row_bytes` is below the bound; beyond it the
    join stays a shuffle join, which adaptive execution may split."""
    return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Set session settings (dots written as two underscores) and put the old ones back."""
    named = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
