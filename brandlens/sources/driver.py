"""Mentions derived from the driver's parquet tables.

The driver tables are not mention payloads, so this module maps them onto the unified
mention schema: ``documents`` gives the text, ``events`` (joined on
``event_id = doc_id * 5``) gives the time, author and a raw model-style answer, and
``labels`` adds quality flags. It only shapes rows; every operator runs on the result
as it would on landed mentions.

``MENTIONS_SQL`` is the same view for DuckDB and is used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenise

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Event types mapped onto raw (unsanitised) topic answers; some are deliberately
# mis-cased, padded or outside the allowed set so the sanitiser has work to do.
_RAW_TOPIC = {
    "error": " Bug_Report ",
    "signup": "feature_request",
    "purchase": "PRAISE",
    "click": "question",
    "view": "chatter",
}
_RAW_SENTIMENT = ("VERY_NEGATIVE", "negative", "mixed", "positive", "very_positive", "angry")
# Languages stand in for the four source platforms.
_PLATFORM = {"en": "reddit", "fr": "twitter", "de": "playstore", "es": "appstore"}


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified mention rows (one per document with a matching event)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id")
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # a document without an event stays, with empty event columns
    j = docs.join(ev, ev["event_id"] == docs["doc_id"] * F.lit(5), "left").join(lab, "doc_id", "left")

    topic = F.lit(None).cast("string")
    for k, v in _RAW_TOPIC.items():
        topic = F.when(F.col("event_type") == k, F.lit(v)).otherwise(topic)
    sent = F.element_at(F.array(*[F.lit(s) for s in _RAW_SENTIMENT]),
                        (F.pmod(F.col("user_id"), F.lit(6)) + 1).cast("int"))
    long_words = F.filter(tokenise(F.col("text")), lambda t: F.length(t) >= 8)
    platform = F.lit("unknown")
    for k, v in _PLATFORM.items():
        platform = F.when(F.col("lang") == k, F.lit(v)).otherwise(platform)
    # a title for sign-up events (first line of the text), '' for clicks, else missing
    title = (F.when(F.col("event_type") == "signup", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
             .when(F.col("event_type") == "click", F.lit("")).otherwise(F.lit(None).cast("string")))
    return j.select(
        F.col("doc_id").cast("string").alias("id"),
        platform.alias("platform"),
        F.col("doc_id").alias("seq"),
        title.alias("title"),
        F.col("text"),
        F.col("user_id").cast("string").alias("author"),
        F.col("source").alias("channel"),
        F.col("ts").alias("event_time"),
        F.floor(F.col("value")).cast("bigint").alias("votes"),
        (F.pmod(F.col("user_id"), F.lit(5)) + 1).cast("int").alias("rating"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("quality"),
        F.col("toxic"),
        (F.pmod(F.col("doc_id"), F.lit(13)) - 1).cast("string").alias("raw_relevance"),
        topic.alias("raw_topic"),
        sent.alias("raw_sentiment"),
        F.slice(long_words, 1, 4).alias("raw_phrases"),
    )


# DuckDB twin of `mentions` (tables are pre-registered views in the oracle).


def _duck_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def duck_tokenise(expr: str, stop_words=None) -> str:
    """DuckDB spelling of :func:`brandlens.functions.text.tokenise`."""
    from ..config import PUNCTUATION, STOP_WORDS

    stop = STOP_WORDS if stop_words is None else stop_words
    punct = PUNCTUATION.replace("'", "''")
    split = (f"regexp_split_to_array(translate(lower(coalesce({expr}, '')), '{punct}', "
             f"'{' ' * len(PUNCTUATION)}'), '[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+')")
    if stop:
        return (f"list_filter({split}, lambda x: length(x) > 1 AND NOT "
                f"list_contains({_duck_list(stop)}, x))")
    return f"list_filter({split}, lambda x: length(x) > 1)"


def duck_split_words(expr: str) -> str:
    from ..config import PUNCTUATION

    punct = PUNCTUATION.replace("'", "''")
    split = (f"regexp_split_to_array(translate(lower(coalesce({expr}, '')), '{punct}', "
             f"'{' ' * len(PUNCTUATION)}'), '[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+')")
    return f"list_filter({split}, lambda x: x <> '')"


def mentions_sql() -> str:
    topic = "CASE " + " ".join(f"WHEN e.event_type = '{k}' THEN '{v}'" for k, v in _RAW_TOPIC.items()) + " END"
    plat = "CASE " + " ".join(f"WHEN d.lang = '{k}' THEN '{v}'" for k, v in _PLATFORM.items()) + " ELSE 'unknown' END"
    return f"""
SELECT CAST(d.doc_id AS VARCHAR) AS id, {plat} AS platform, d.doc_id AS seq,
       CASE WHEN e.event_type = 'signup' THEN split_part(d.text, chr(10), 1)
            WHEN e.event_type = 'click' THEN '' ELSE CAST(NULL AS VARCHAR) END AS title, d.text AS text, CAST(e.user_id AS VARCHAR) AS author,
       d.source AS channel, e.ts AS event_time, CAST(floor(e.value) AS BIGINT) AS votes,
       CAST(((e.user_id % 5 + 5) % 5) + 1 AS INTEGER) AS rating, e.user_id AS user_id,
       e.event_type AS event_type, l.quality AS quality, l.toxic AS toxic,
       CAST(((d.doc_id % 13 + 13) % 13) - 1 AS VARCHAR) AS raw_relevance,
       {topic} AS raw_topic,
       {_duck_list(_RAW_SENTIMENT)}[CAST(((e.user_id % 6 + 6) % 6) + 1 AS INTEGER)] AS raw_sentiment,
       list_slice(list_filter({duck_tokenise('d.text')}, lambda t: length(t) >= 8), 1, 4) AS raw_phrases
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 5
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
