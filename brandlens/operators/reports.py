"""Ordering, ranking and roll-up operators.

Global order without a single-partition window
----------------------------------------------
`global_rank` numbers rows 1..N in a total order the way `zipWithIndex` does, but in
DataFrame form: range-partition on the ordering (AQE may coalesce neighbouring ranges,
which keeps partition ids in range order), sort inside each partition,
number rows locally with `monotonically_increasing_id` (partition id in the high bits,
row index in the low 33 bits), write that table once to the checkpoint folder, then add
the row count of all earlier partitions (one row per partition, broadcast). The ordering
must be a total order: pass a unique tiebreaker as the last key, which also splits a
heavily repeated value over several range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rnk",
                num_partitions: int | None = None) -> DataFrame:
    """Add `name` = 1-based position of each row in `order` (must be a total order)."""
    # without an explicit count AQE may coalesce neighbouring ranges, which keeps the
    # partition ids in range order
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    r = (ranged.sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Written once: the counts and the numbering must come from the same partitioning.
    # Two evaluations of a range exchange sample their bounds independently, so they
    # can disagree; the written table (shared checkpoint folder) fixes pid and index.
    r = materialise(r, "rank")
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: safe to number in a single task and to broadcast
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = (r.join(F.broadcast(offsets), "_pid")
           .withColumn(name, (F.col("_off") + local + F.lit(1)).cast("bigint"))
           .drop("_pid", "_mid", "_off"))
    out._stage_path = r._stage_path  # for `release`
    return out


def rank_by(df: DataFrame, order: Sequence[Column], limit: int | None = None,
            name: str = "rnk") -> DataFrame:
    """Rows in `order` with a 1-based rank column; with `limit`, only the top rows.

    With a limit Spark plans TakeOrderedAndProject (k rows per partition), so the final
    numbering runs over at most `limit` rows.
    """
    if limit is not None:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return global_rank(df, order, name)


def newest_first_order(time_col: str = "event_time", seq_col: str = "seq") -> list[Column]:
    """Newest first, missing times last, ties by arrival order."""
    return [F.col(time_col).desc_nulls_last(), F.col(seq_col).asc()]

