"""Landed JSON: missing, truncated and empty files; flattening; normalising; sinks."""

import json
import os

from pyspark.sql import functions as F

from brandlens.operators.rollups import is_digest_day
from brandlens.session import scratch_dir
from brandlens.sources.landed import (PLAY_REVIEW, REDDIT_PAGE, TWEET, flatten_listing, normalise_play,
                                      normalise_reddit, normalise_tweets, read_json_lenient)
from brandlens.sources.sinks import read_envelope, write_envelope


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_lenient_read_cases(spark):
    base = scratch_dir(spark, "t-json").replace("file:", "")
    good = json.dumps([{"reviewId": "a", "content": "fine", "score": 4}, {"reviewId": "b"}])
    _write(f"{base}/good.json", good)
    _write(f"{base}/trunc.json", '[{"reviewId":"x"},{"reviewId"')
    _write(f"{base}/empty.json", "[]")
    df = read_json_lenient(spark, [f"{base}/good.json", f"{base}/missing.json", f"{base}/trunc.json",
                                   f"{base}/empty.json"], PLAY_REVIEW, multi_line=True)
    rows = normalise_play(df).collect()
    assert sorted(r.id for r in rows) == ["a", "b"]
    b = [r for r in rows if r.id == "b"][0]
    assert (b.text, b.rating, b.event_time) == ("", 0, None)


def test_reddit_listing_flatten_and_fallbacks(spark):
    base = scratch_dir(spark, "t-json").replace("file:", "")
    page = {"data": {"after": None, "children": [
        {"data": {"id": "p1", "title": "T", "selftext": "", "body": "from body", "score": 3,
                  "permalink": "/r/x/p1", "created_utc": 0}},
        {"data": {"id": "", "title": "no id"}},
        {"data": {"id": "p2", "selftext": "self", "body": "ignored"}}]}}
    _write(f"{base}/page.json", json.dumps(page))
    rows = {r.id: r for r in normalise_reddit(flatten_listing(
        read_json_lenient(spark, [f"{base}/page.json"], REDDIT_PAGE, multi_line=True))).collect()}
    assert sorted(rows) == ["p1", "p2"]
    assert rows["p1"].text == "from body" and rows["p2"].text == "self"
    assert rows["p1"].url == "https://reddit.com/r/x/p1" and rows["p2"].title == ""
    assert rows["p1"]._arrival < rows["p2"]._arrival


def test_tweet_defaults(spark):
    base = scratch_dir(spark, "t-json").replace("file:", "")
    _write(f"{base}/t.json", json.dumps([{"id": 7, "rawContent": "hi"}]))
    r = normalise_tweets(read_json_lenient(spark, [f"{base}/t.json"], TWEET, multi_line=True)).first()
    assert (r.id, r.text, r.author, r.likes, r.replies, r.event_time) == ("7", "hi", "", 0, 0, None)


def test_envelope_versions(spark):
    out = scratch_dir(spark, "t-env")
    recs = spark.createDataFrame([("reddit", "1"), ("twitter", "2")], "platform string, id string")
    meta = spark.createDataFrame([(2,)], "total long")
    write_envelope(recs, meta, out)
    write_envelope(recs.where(F.col("id") == "1"), spark.createDataFrame([(1,)], "total long"), out)
    r, m = read_envelope(spark, out)
    assert r.count() == 1 and m.first().total == 1


def test_digest_day(spark):
    got = spark.range(1).select(is_digest_day("2024-01-14").alias("sun"), is_digest_day("2024-01-15").alias("mon"),
                                is_digest_day("2024-01-15", force=True).alias("forced")).first()
    assert (got.sun, got.mon, got.forced) == (True, False, True)


def test_load_sources_dense_arrival_order(spark):
    from brandlens.sources.landed import load_sources
    base = scratch_dir(spark, "t-json").replace("file:", "")
    page = {"data": {"after": None, "children": [{"data": {"id": f"r{i}", "title": "t"}} for i in range(5)]}}
    _write(f"{base}/reddit.json", json.dumps(page))
    _write(f"{base}/tw1.json", json.dumps([{"id": i, "rawContent": "x"} for i in range(3)]))
    _write(f"{base}/tw2.json", json.dumps([{"id": 10 + i, "rawContent": "y"} for i in range(2)]))
    rows = load_sources(spark, reddit=[f"{base}/reddit.json"], twitter=[f"{base}/tw1.json", f"{base}/tw2.json"],
                        multi_line=True).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 11))
    assert [r.id for r in rows] == [f"r{i}" for i in range(5)] + ["0", "1", "2", "10", "11"]


def test_alert_cloud_digest_sinks(spark):
    from brandlens.sources.sinks import write_alerts, write_digest, write_word_cloud
    base = scratch_dir(spark, "t-sinks")
    alerts = spark.createDataFrame([("r", "1", "bug_report", "very_negative")],
                                   "platform string, id string, topic string, llm_sentiment string")
    write_alerts(alerts, f"{base}/alerts")
    assert spark.read.json(f"{base}/alerts").select("id").first().id == "1"
    cloud = spark.createDataFrame([("word", 3, 1), ("other", 2, 2)], "word string, count long, rnk long")
    write_word_cloud(cloud, f"{base}/cloud")
    got = sorted((r.word, r["count"]) for r in spark.read.json(f"{base}/cloud").collect())
    assert got == [("other", 2), ("word", 3)]
    write_digest(spark.createDataFrame([("Weekly digest\nline",)], "text string"), f"{base}/digest")
    assert [r.value for r in spark.read.text(f"{base}/digest").collect()] == ["Weekly digest", "line"]


def test_folder_order_does_not_depend_on_file_sizes(spark):
    from brandlens.operators.dedup import dedup_first
    from brandlens.sources.landed import load_sources
    base = scratch_dir(spark, "t-json").replace("file:", "")
    old = [{"id": 1, "rawContent": "first fetch"}]
    new = [{"id": 1, "rawContent": "second fetch"}] + [{"id": i, "rawContent": "x" * 200} for i in range(2, 4000)]
    for name, rows in (("2024-01-01", old), ("2024-01-02", new)):
        _write(f"{base}/tw/{name}.json", "\n".join(map(json.dumps, rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "50000"):  # whole files, then many splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = dedup_first(load_sources(spark, twitter=[f"{base}/tw"])).orderBy("seq").collect()
            assert [r.id for r in rows] == [str(i) for i in range(1, 4000)]
            assert rows[0].text == "first fetch"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_wins_over_two_lists(spark):
    from brandlens.sources.landed import load_sources
    base = scratch_dir(spark, "t-json").replace("file:", "")
    _write(f"{base}/new.json", json.dumps([{"reviewId": "a", "content": "newest"}, {"reviewId": "b"}]))
    _write(f"{base}/rel.json", json.dumps([{"reviewId": "a", "content": "relevant"}, {"reviewId": "c"}]))
    rows = load_sources(spark, playstore=[f"{base}/new.json", f"{base}/rel.json"], multi_line=True,
                        first_wins=True).collect()
    assert sorted((r.id, r.text) for r in rows) == [("a", "newest"), ("b", ""), ("c", "")]
    assert all(r.scraped_at is not None for r in rows)


def test_all_malformed_is_an_error(spark):
    import pytest
    base = scratch_dir(spark, "t-json").replace("file:", "")
    _write(f"{base}/indented.json", json.dumps([{"reviewId": "a"}, {"reviewId": "b"}], indent=2))
    with pytest.raises(ValueError, match="multi_line"):
        read_json_lenient(spark, [f"{base}/indented.json"], PLAY_REVIEW)
    assert read_json_lenient(spark, [f"{base}/indented.json"], PLAY_REVIEW, multi_line=True).count() == 2
