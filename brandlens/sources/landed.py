"""Landed source payloads -> unified mention rows.

Each source lands raw JSON (one file per fetch). Files are read with an explicit schema
(no inference pass), malformed records are dropped (a path with nothing but malformed records
is an error), and a missing file is skipped. A JSON-array file needs ``multi_line=True``; at
scale, land JSON Lines so files split.

Arrival order: every row carries its arrival key (source, position of the path, file name,
split, row, position inside a listing page); file names must sort by time of fetch. `seq` is
null until `load_sources` turns the keys into exact dense numbers with `global_rank` (range
partitioning, no single task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SOURCE_ORDER
from ..functions.text import nullif_empty
from ..operators.dedup import dedup_first
from ..operators.reports import global_rank

# Raw payload schemas (field names are the sources' own).
REDDIT_PAGE = ("data struct<children: array<struct<data: struct<id: string, subreddit: string, "
               "title: string, selftext: string, body: string, author: string, score: bigint, "
               "permalink: string, created_utc: double>>>, after: string>")
TWEET = ("id bigint, rawContent string, user struct<username: string, displayname: string, "
         "followersCount: bigint>, likeCount bigint, retweetCount bigint, replyCount bigint, "
         "url string, date timestamp")
PLAY_REVIEW = ("reviewId string, at timestamp, content string, userName string, score int, "
               "thumbsUpCount bigint, reviewCreatedVersion string, replyContent string")
APPSTORE_REVIEW = "userName string, date timestamp, title string, review string, rating int, version string"

# Unified mention columns produced by every normaliser.
MENTION_COLUMNS = ("id", "platform", "seq", "title", "text", "author", "url", "channel",
                   "event_time", "votes", "rating", "app_version", "reply_text",
                   "followers", "likes", "retweets", "replies", "thumbs_up", "display_name",
                   "scraped_at")
_TYPES = {"seq": "bigint", "event_time": "timestamp_ntz", "votes": "bigint", "rating": "int",
          "followers": "bigint", "likes": "bigint", "retweets": "bigint", "replies": "bigint",
          "thumbs_up": "bigint", "scraped_at": "timestamp_ntz"}

_CORRUPT = "_corrupt_record"


def read_json_lenient(spark: SparkSession, paths: Sequence[str], schema: str,
                      multi_line: bool = False, check: bool = True) -> DataFrame:
    """Union of the readable files; missing paths are skipped, malformed records dropped.

    Adds `_file_rank` (position of the path in `paths`), `_file`, `_block` and `_row` (the
    file, the start of the split that held the record, and the order inside it), which
    order the records as they lie in the files, however the files are split.

    With `check` a path whose records are all malformed raises an error that names the
    counts, e.g. an indented JSON array read without `multi_line`.
    """
    out = None
    for i, p in enumerate(paths):
        try:
            read = spark.read.option("multiLine", multi_line)
            df = read.schema(schema).option("mode", "DROPMALFORMED").json(p)
            df.schema  # noqa: B018 - resolves the path now
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        if check and not multi_line:
            every = (read.schema(f"{schema}, {_CORRUPT} string").option("mode", "PERMISSIVE")
                     .option("columnNameOfCorruptRecord", _CORRUPT).json(p))
            bad, good, _ = every.agg(F.count(_CORRUPT), F.count_if(F.col(_CORRUPT).isNull()),
                                     F.count(every.columns[0])).first()
            if bad and not good:
                raise ValueError(f"{p}: all {bad} records are malformed; is it an array that needs multi_line=True?")
        df = (df
              .select("*", F.lit(i).alias("_file_rank"), F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.col("_metadata.file_modification_time").alias("_scraped_at"))
              .withColumn("_row", F.monotonically_increasing_id()))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], f"{schema}, _file_rank int, _file string, _block long, _scraped_at timestamp, _row long")
    return out


def _source_rank(platform: str) -> int:
    return SOURCE_ORDER.index(platform) if platform in SOURCE_ORDER else len(SOURCE_ORDER)


def _finish(df: DataFrame, cols: dict, platform: str) -> DataFrame:
    cols = {**cols, "scraped_at": F.col("_scraped_at")}  # when the file was landed
    sel = []
    for c in MENTION_COLUMNS:
        e = cols.get(c, F.lit(None))
        sel.append(e.cast(_TYPES.get(c, "string")).alias(c))
    # the arrival key; load_sources turns it into numbers
    key = F.struct(F.lit(_source_rank(platform)).alias("source"), F.col("_file_rank").alias("path"),
                   F.col("_file").alias("file"), F.col("_block").alias("block"),
                   F.col("_row").alias("row"), F.col("_pos").alias("place")).alias("_arrival")
    return df.select(*sel, key).where(F.coalesce(F.col("id"), F.lit("")) != "")


def _with_pos(df: DataFrame) -> DataFrame:
    return df if "_pos" in df.columns else df.withColumn("_pos", F.lit(0))


def flatten_listing(pages: DataFrame) -> DataFrame:
    """Listing pages -> one row per child post/comment (fields of `data.children[].data`)."""
    key = ["_file_rank", "_file", "_block", "_row", "_scraped_at"]
    ex = pages.select(*key, F.posexplode("data.children").alias("_pos", "child"))
    return ex.select(*key, "_pos", "child.data.*")


def normalise_reddit(posts: DataFrame) -> DataFrame:
    posts = _with_pos(posts)
    return _finish(posts, {
        "id": F.col("id"), "platform": F.lit("reddit"),
        "title": F.coalesce(F.col("title"), F.lit("")),
        "text": F.coalesce(nullif_empty("selftext"), nullif_empty("body"), F.lit("")),
        "author": F.coalesce(F.col("author"), F.lit("")),
        "url": F.concat(F.lit("https://reddit.com"), F.coalesce(F.col("permalink"), F.lit(""))),
        "channel": F.coalesce(F.col("subreddit"), F.lit("")),
        "event_time": F.timestamp_seconds(F.coalesce(F.col("created_utc"), F.lit(0.0))),
        "votes": F.coalesce(F.col("score"), F.lit(0)),
    }, "reddit")


def normalise_tweets(tweets: DataFrame) -> DataFrame:
    tweets = _with_pos(tweets)
    return _finish(tweets, {
        "id": F.col("id").cast("string"), "platform": F.lit("twitter"),
        "text": F.coalesce(F.col("rawContent"), F.lit("")),
        "author": F.coalesce(F.col("user.username"), F.lit("")),
        "url": F.coalesce(F.col("url"), F.lit("")), "event_time": F.col("date"),
        "followers": F.coalesce(F.col("user.followersCount"), F.lit(0)),
        "likes": F.coalesce(F.col("likeCount"), F.lit(0)),
        "retweets": F.coalesce(F.col("retweetCount"), F.lit(0)),
        "replies": F.coalesce(F.col("replyCount"), F.lit(0)),
        "display_name": F.coalesce(F.col("user.displayname"), F.lit("")),
    }, "twitter")


def normalise_play(reviews: DataFrame, app_url: str = "") -> DataFrame:
    reviews = _with_pos(reviews)
    return _finish(reviews, {
        "id": F.col("reviewId"), "platform": F.lit("playstore"),
        "text": F.coalesce(F.col("content"), F.lit("")),
        "author": F.coalesce(F.col("userName"), F.lit("")), "url": F.lit(app_url),
        "event_time": F.col("at"), "rating": F.coalesce(F.col("score"), F.lit(0)),
        "thumbs_up": F.coalesce(F.col("thumbsUpCount"), F.lit(0)),
        "app_version": F.coalesce(F.col("reviewCreatedVersion"), F.lit("")),
        "reply_text": F.coalesce(F.col("replyContent"), F.lit("")),
    }, "playstore")


def normalise_appstore(reviews: DataFrame) -> DataFrame:
    """id = 'ios_' + SHA-256(user + date): stable across runs (the original's was not)."""
    key = F.concat(F.coalesce(F.col("userName"), F.lit("")),
                   F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("")))
    reviews = _with_pos(reviews)
    return _finish(reviews, {
        "id": F.concat(F.lit("ios_"), F.sha2(key, 256)), "platform": F.lit("appstore"),
        "title": F.coalesce(F.col("title"), F.lit("")),
        "text": F.coalesce(F.col("review"), F.lit("")),
        "author": F.coalesce(F.col("userName"), F.lit("")), "event_time": F.col("date"),
        "rating": F.coalesce(F.col("rating"), F.lit(0)),
        "app_version": F.coalesce(F.col("version"), F.lit("")),
    }, "appstore")


def load_sources(spark: SparkSession, reddit: Sequence[str] = (), twitter: Sequence[str] = (),
                 playstore: Sequence[str] = (), appstore: Sequence[str] = (),
                 multi_line: bool = False, first_wins: bool = False) -> DataFrame:
    """All four sources normalised and unioned (source order reddit, twitter, play, app).

    With `first_wins` only the first arrival of each (platform, id) stays, e.g. when the Play
    Store paths are a list of the newest and a list of the most relevant reviews.
    """
    parts = [
        normalise_reddit(flatten_listing(read_json_lenient(spark, reddit, REDDIT_PAGE, multi_line))),
        normalise_tweets(read_json_lenient(spark, twitter, TWEET, multi_line)),
        normalise_play(read_json_lenient(spark, playstore, PLAY_REVIEW, multi_line)),
        normalise_appstore(read_json_lenient(spark, appstore, APPSTORE_REVIEW, multi_line)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # exact dense arrival numbers over (source, file, row, position): one range shuffle,
    # no assumption about partition or file counts
    ranked = global_rank(out, [F.col("_arrival")], "_seq")
    numbered = ranked.withColumn("seq", F.col("_seq")).select(*MENTION_COLUMNS)
    return dedup_first(numbered) if first_wins else numbered
