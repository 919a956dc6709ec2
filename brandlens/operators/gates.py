"""Row filters: relevance gates, look-back window, critical flag, relevance floor.

All are deterministic Catalyst predicates, so they are pushed below joins and, where
they touch stored columns only (platform, event_time), into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DIGEST_DAYS, RELEVANCE_MIN, BrandProfile
from ..functions.text import contains_any


def gate_text(title="title", text="text") -> Column:
    """lower(title + ' ' + text) with missing parts as ''."""
    t = F.col(title) if isinstance(title, str) else title
    x = F.col(text) if isinstance(text, str) else text
    return F.lower(F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(x, F.lit(""))))


def relevance_gate(profile: BrandProfile, title="title", text="text",
                   require_keywords: bool = True, whole_word: bool = False) -> Column:
    """Brand present, no blocked phrase, and (optionally) at least one context keyword.

    Substring semantics by default (a keyword also matches inside a longer word);
    `whole_word=True` requires word boundaries for all three rules.
    """
    full = gate_text(title, text)
    cond = contains_any(full, [profile.brand], whole_word)
    if profile.blocklist:
        cond = cond & ~contains_any(full, profile.blocklist, whole_word)
    if require_keywords and profile.keywords:
        cond = cond & contains_any(full, profile.keywords, whole_word)
    elif require_keywords:
        cond = cond & F.lit(False)
    return cond


def lookback(as_of: str, days: int = DIGEST_DAYS, time_col: str = "event_time") -> Column:
    """Rows on or after the day `days` before `as_of` (lower bound only)."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    return F.col(time_col) >= since.cast("timestamp_ntz")


def is_critical(topic: str = "topic", sentiment: str = "llm_sentiment") -> Column:
    return (F.col(topic) == F.lit("bug_report")) & (F.col(sentiment) == F.lit("very_negative"))


def relevant_only(relevance: str = "relevance", floor: int = RELEVANCE_MIN) -> Column:
    return F.col(relevance) >= F.lit(floor)
