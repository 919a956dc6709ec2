"""Stand-in inputs of the registered queries: landed payloads and a model.

Nothing of the engine uses them; they only give queries an input that the tables lack.

Only shapes rows into each source's raw JSON layout (listing pages of 50 for reddit,
one object per tweet / review) and writes them as JSON Lines under the shared
checkpoint folder; the source readers then do the actual work on those files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import global_rank
from ..session import scratch_dir

PAGE_SIZE = 50
# keep microseconds (Spark's JSON writer defaults to milliseconds)
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_landed(m: DataFrame) -> dict[str, str]:
    """Write four source folders from mention rows; return {platform: path}."""
    base = scratch_dir(m.sparkSession, "landed")
    r = m.where(F.col("platform") == "reddit")
    r = global_rank(r, [F.col("seq").asc()], "_rk").withColumn(
        "page", F.floor((F.col("_rk") - 1) / PAGE_SIZE))
    child = F.struct(F.struct(
        F.col("id"), F.col("channel").alias("subreddit"), F.col("title"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("text")).alias("selftext"),
        F.when(F.col("event_type") == "view", F.col("text")).alias("body"),
        F.col("author"), F.col("votes").alias("score"),
        F.concat(F.lit("/r/"), F.col("channel"), F.lit("/"), F.col("id")).alias("permalink"),
        F.floor(F.unix_micros(F.col("event_time").cast("timestamp")) / 1_000_000).cast("double")
        .alias("created_utc")).alias("data"))
    pages = r.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("_rk", child.alias("c")))).alias("xs"))
    pages.select(F.struct(F.transform("xs", lambda x: x["c"]).alias("children"),
                          F.concat(F.lit("t3_"), F.col("page").cast("string")).alias("after")).alias("data")) \
        .write.option("timestampFormat", TS_FORMAT).json(f"{base}/reddit")

    t = m.where(F.col("platform") == "twitter")
    t.select(F.col("id").cast("bigint").alias("id"), F.col("text").alias("rawContent"),
             F.struct(F.col("author").alias("username"), F.col("author").alias("displayname"),
                      (F.col("votes") * 10).alias("followersCount")).alias("user"),
             F.col("votes").alias("likeCount"),
             F.when(F.col("rating") > 2, F.col("rating").cast("bigint")).alias("retweetCount"),
             F.lit(0).cast("bigint").alias("replyCount"),
             F.concat(F.lit("https://x.invalid/"), F.col("id")).alias("url"),
             F.col("event_time").cast("timestamp").alias("date")).write.option("timestampFormat", TS_FORMAT).json(f"{base}/twitter")

    p = m.where(F.col("platform") == "playstore")
    p.select(F.col("id").alias("reviewId"), F.col("event_time").cast("timestamp").alias("at"),
             F.col("text").alias("content"), F.col("author").alias("userName"),
             F.col("rating").alias("score"), F.col("votes").alias("thumbsUpCount"),
             F.concat(F.lit("1."), F.col("rating").cast("string")).alias("reviewCreatedVersion"),
             F.lit(None).cast("string").alias("replyContent")).write.option("timestampFormat", TS_FORMAT).json(f"{base}/playstore")

    a = m.where(F.col("platform") == "appstore")
    a.select(F.concat(F.col("author"), F.lit("-"), F.col("id")).alias("userName"),
             F.col("event_time").cast("timestamp").alias("date"), F.col("title"),
             F.col("text").alias("review"), F.col("rating"),
             F.concat(F.lit("2."), F.col("rating").cast("string")).alias("version")).write.option("timestampFormat", TS_FORMAT).json(f"{base}/appstore")
    return {k: f"{base}/{k}" for k in ("reddit", "twitter", "playstore", "appstore")}


def stand_in_model(prompts: list[str]) -> list[str]:
    """Answers of `stand_in_answer` to each prompt."""
    return [stand_in_answer(p) for p in prompts]


def stand_in_answer(prompt: str) -> str:
    """Deterministic stand-in model: answers from the prompt's own numbered items.

    Relevance grows with the item's length, topic and sentiment follow simple word cues.
    Only for tests and offline runs; a real deployment passes its own `model_fn`.
    """
    import json
    import re

    answers = []
    for body in re.findall(r"^<<post \d+ from [^>]*>>\n(.*?)\n<<end>>$", prompt, flags=re.M | re.S):
        words = body.lower().split()
        rel = min(10, len(words) // 8)
        topic = ("bug_report" if any(w.startswith(("crash", "bug", "error")) for w in words)
                 else "question" if body.rstrip().endswith("?") else "general")
        sent = "negative" if topic == "bug_report" else "mixed"
        answers.append({"relevance": rel, "topic": topic, "llm_sentiment": sent,
                        "key_phrases": sorted(set(w for w in words if len(w) > 6))[:3],
                        "is_critical": False})
    return json.dumps(answers)
