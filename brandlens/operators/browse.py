"""Dashboard browse: optional filters and a sort mode, with a rank column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import combined_text, fuzzy_contains
from . import gates
from .reports import global_rank, newest_first_order

SORTS = {
    "newest": lambda: newest_first_order(),
    "bm25": lambda: [F.col("bm25_score").desc_nulls_last(), F.col("seq").asc()],
    "most_negative": lambda: [F.col("compound").asc_nulls_last(), F.col("seq").asc()],
    "most_positive": lambda: [F.col("compound").desc_nulls_last(), F.col("seq").asc()],
}


def browse(df: DataFrame, platform: str | None = None, search: str | None = None,
           since_days: int | None = None, as_of: str | None = None, sort: str = "newest",
           hide_duplicates: bool = False, topic: str | None = None,
           critical_only: bool = False, until: str | None = None, sentiment: str | None = None,
           fuzzy: Sequence[str] = ()) -> DataFrame:
    """Filtered rows ranked by `sort` (newest, bm25, most_negative, most_positive).

    Text search is a case-insensitive substring match over title + text; `fuzzy` words match
    with spelling mistakes. `until` is the last day shown, `sentiment` a label (positive,
    neutral, negative). Sorting by bm25 or compound and filtering by label need those columns
    on `df` (see search_enrich / lexicon_sentiment).
    """
    x = df
    if platform is not None:
        x = x.where(F.col("platform") == F.lit(platform))
    if since_days is not None:
        x = x.where(gates.lookback(as_of, since_days))
    if search:
        x = x.where(F.instr(gates.gate_text("title", "text"), search.lower()) > 0)
    if fuzzy:
        x = x.where(fuzzy_contains(combined_text("title", "text"), tuple(fuzzy)))
    if until is not None:
        x = x.where(F.to_date("event_time") <= F.lit(until).cast("date"))
    if sentiment is not None:
        x = x.where(F.col("label") == F.lit(sentiment))
    if hide_duplicates:
        x = x.where(~F.coalesce(F.col("is_near_duplicate"), F.lit(False)))
    if topic is not None:
        x = x.where(F.col("topic") == F.lit(topic))
    if critical_only:
        x = x.where(F.col("is_critical"))
    return global_rank(x, SORTS[sort]())
