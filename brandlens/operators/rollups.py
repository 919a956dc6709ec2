"""Counts, shares, daily series and digest samples.

All roll-ups are hash aggregates with partial (map-side) aggregation, so a dominant
platform or topic adds one row per task to the shuffle. `meta_rollup` computes every
dimension in one scan with GROUPING SETS instead of one job per dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIGEST_SAMPLES, DIGEST_SNIPPET, SENTIMENT_LABELS
from ..functions.text import first_nonempty


def count_by(df: DataFrame, col: str, missing: str, name: str | None = None) -> DataFrame:
    """`name`, n: rows per value of `col`, NULL counted as `missing`."""
    return df.groupBy(F.coalesce(F.col(col), F.lit(missing)).alias(name or col)).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def _label_spine(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A tiny literal table of the fixed labels (size = len(labels))."""
    return df.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def count_by_sentiment(sent: DataFrame, labels: Sequence[str] = SENTIMENT_LABELS) -> DataFrame:
    """label, n for exactly the fixed labels (0 when absent; other labels ignored)."""
    c = sent.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spine = F.broadcast(_label_spine(sent, labels))
    return spine.join(c, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def alert_status(df: DataFrame, flag: str = "is_critical") -> DataFrame:
    """One row: critical count and 'CRITICAL:n' or 'OK'."""
    c = df.agg(F.count_if(F.col(flag)).cast("bigint").alias("critical"))
    return c.select("critical", F.when(F.col("critical") > 0, F.concat(F.lit("CRITICAL:"),
                    F.col("critical").cast("string"))).otherwise(F.lit("OK")).alias("status"))


def meta_rollup(df: DataFrame, dims: Mapping[str, str] | None = None, sentiment: bool = True,
                labels: Sequence[str] = SENTIMENT_LABELS, flag: str = "is_critical") -> DataFrame:
    """Long-form meta: (dimension, key, n) for total, critical, each dim and sentiment.

    One scan: GROUPING SETS over the dimensions plus the grand total, unpivoted in the
    same pass (one branch, so the input is evaluated once). Sentiment always lists the
    fixed labels (0 when absent, other labels ignored): a literal 3-row spine is added
    to the small result and summed.
    """
    dims = dict(dims or {"platform": "unknown", "topic": "general"})
    cols = {d: F.coalesce(F.col(d), F.lit(miss)) for d, miss in dims.items()}
    if sentiment:
        cols["sentiment"] = F.col("label")
    x = df.select(*[c.alias(f"_{d}") for d, c in cols.items()], F.col(flag).alias("_crit"))
    names = [f"_{d}" for d in cols]
    sets = [[F.col(n)] for n in names] + [[]]
    g = x.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("n"), F.count_if("_crit").alias("crit"),
                                         F.grouping_id().alias("gid"))
    full = (1 << len(names)) - 1

    def row(dim, key, n):
        return F.struct(F.lit(dim).alias("dimension"), key.cast("string").alias("key"),
                        n.cast("bigint").alias("n"))

    items = [F.when(F.col("gid") == full, row("total", F.lit(""), F.col("n"))),
             F.when(F.col("gid") == full, row("critical", F.lit(""), F.col("crit")))]
    for i, d in enumerate(cols):
        gid = full ^ (1 << (len(names) - 1 - i))
        items.append(F.when(F.col("gid") == gid, row(d, F.col(f"_{d}"), F.col("n"))))
    long = g.select(F.explode(F.filter(F.array(*items), lambda e: e.isNotNull())).alias("r")).select("r.*")
    if not sentiment:
        return long
    spine = df.sparkSession.createDataFrame([("sentiment", x_, 0) for x_ in labels],
                                            "dimension string, key string, n bigint")
    keep = (F.col("dimension") != "sentiment") | F.col("key").isin(list(labels))
    return long.unionByName(spine).where(keep).groupBy("dimension", "key").agg(
        F.sum("n").cast("bigint").alias("n"))


def breakdown_share(df: DataFrame, dims: Mapping[str, str]) -> DataFrame:
    """(dimension, key, n, share of the dimension's total) — one grouping-sets pass."""
    cols = {d: F.coalesce(F.col(d), F.lit(miss)) for d, miss in dims.items()}
    names = [f"_{d}" for d in cols]
    x = df.select(*[c.alias(f"_{d}") for d, c in cols.items()])
    g = x.groupingSets([[F.col(n)] for n in names], *names).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(names)) - 1
    dim = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for i, d in enumerate(cols):
        gid = full ^ (1 << (len(names) - 1 - i))
        dim = F.when(F.col("gid") == gid, F.lit(d)).otherwise(dim)
        key = F.when(F.col("gid") == gid, F.col(f"_{d}")).otherwise(key)
    out = g.select(dim.alias("dimension"), key.alias("key"), F.col("n").cast("bigint").alias("n"))
    # a dimension has few distinct keys, so this window is small
    tot = F.sum("n").over(Window.partitionBy("dimension"))
    return out.select("dimension", "key", "n", F.round(F.col("n") / tot, 6).alias("share"))


def daily_counts(df: DataFrame, by: Sequence[str] = (), time_col: str = "event_time") -> DataFrame:
    return df.groupBy(*by, F.to_date(time_col).alias("day")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def sentiment_trend(df: DataFrame, labels: Sequence[str] = SENTIMENT_LABELS, days: int = 7,
                    time_col: str = "event_time") -> DataFrame:
    """day, label, n (zero-filled), avg_7d = mean of n over the day and the 6 before.

    The day spine spans min..max day (size = number of days, not rows), built with
    `sequence` from a one-row aggregate and exploded with the label list (no join).
    """
    d = df.select(F.to_date(time_col).alias("day"), "label")
    cnt = d.groupBy("day", "label").agg(F.count(F.lit(1)).alias("n"))
    span = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day")) \
        .select("day", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    z = spine.join(cnt, ["day", "label"], "left").select("day", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    w = Window.partitionBy("label").orderBy("day").rowsBetween(-(days - 1), 0)
    return z.select("day", "label", "n", F.round(F.avg("n").over(w), 6).alias("avg_7d"))


def digest_samples(df: DataFrame, order: Sequence[Column],
                   samples: Sequence[tuple[str, int]] = DIGEST_SAMPLES,
                   snippet: int = DIGEST_SNIPPET) -> DataFrame:
    """First k rows of each bucket in `order` (a row may sit in several buckets).

    Buckets: negative / positive model sentiment, bug reports, feature requests.
    `row_number() <= k` is planned as WindowGroupLimit, so each task keeps k rows per
    bucket before the shuffle even when one bucket holds most rows.
    """
    k = dict(samples)
    tags = F.filter(F.array(
        F.when(F.col("llm_sentiment").isin("very_negative", "negative"), F.lit("negative")),
        F.when(F.col("llm_sentiment").isin("very_positive", "positive"), F.lit("positive")),
        F.when(F.col("topic") == "bug_report", F.lit("bug")),
        F.when(F.col("topic") == "feature_request", F.lit("feature"))), lambda t: t.isNotNull())
    # the snippet stands for the text from here on, so the window moves no whole texts
    short = F.substring(F.coalesce(first_nonempty("title", "text"), F.lit("")), 1, snippet)
    x = df.select("*", F.explode(tags).alias("bucket"), short.alias("snippet")).drop("title", "text")
    w = Window.partitionBy("bucket").orderBy(*order)
    lim = F.lit(None)
    for b, n in k.items():
        lim = F.when(F.col("bucket") == b, F.lit(n)).otherwise(lim)
    r = x.withColumn("rn", F.row_number().over(w))
    r = r.where(F.col("rn") <= F.lit(max(k.values()))).where(F.col("rn") <= lim)
    return r.withColumn("rn", F.col("rn").cast("bigint"))


def is_digest_day(as_of: str, force: bool = False) -> Column:
    """The digest is produced on Sundays, or whenever forced."""
    return F.lit(True) if force else F.dayofweek(F.lit(as_of).cast("date")) == F.lit(1)


#: Our own words of the digest; a caller may pass others.
DIGEST_WORDS = {"title": "What people said,", "total": "Posts in all", "platforms": "Where", "critical": "Urgent faults",
                "negative": "Unhappy", "positive": "Happy", "bug": "Something is broken", "feature": "Wishes",
                "nothing": "(nothing)"}


def digest_by_model(digest: DataFrame, model_fn: Callable[[list[str]], list[str]], instruction: str) -> DataFrame:
    """The digest's text rewritten by the model; as it was if the model fails."""
    from .classify import call_model

    prompts = digest.select(F.lit(0).cast("long").alias("batch_id"), F.lit(1).alias("n"),
                            F.concat(F.lit(instruction + "\n\n"), F.col("text")).alias("prompt"), "text")
    answer = call_model(prompts, model_fn, tasks=1).select("batch_id", "response")
    return prompts.join(answer, "batch_id").select(F.coalesce("response", "text").alias("text"))


def digest_text(stats: DataFrame, samples: DataFrame, as_of: str, days: int,
                words: Mapping[str, str] = DIGEST_WORDS, force: bool = True) -> DataFrame:
    """One row `text`: the weekly digest body (header, counts, sample snippets per bucket), in
    the given `words`.

    No row unless `as_of` is a Sunday or `force` is set.

    `stats` is the long-form (dimension, key, n) of the look-back window and `samples`
    the output of `digest_samples`; both are bounded (a few keys, k rows per bucket), so
    gathering them into one row moves at most a few dozen rows.
    """
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    plat = stats.where(F.col("dimension") == "platform").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col("key"), F.lit(": "), F.col("n").cast("string")))),
                     ", ").alias("by_platform"))
    tot = stats.agg(F.max(F.when(F.col("dimension") == "total", F.col("n"))).alias("total"),
                    F.max(F.when(F.col("dimension") == "critical", F.col("n"))).alias("critical"))
    parts = []
    for b in ("negative", "positive", "bug", "feature"):
        lines = samples.where(F.col("bucket") == b).agg(
            F.array_sort(F.collect_list(F.struct("rn", F.concat(F.lit("- "), F.col("snippet")).alias("l"))))
            .alias("xs")).select(F.coalesce(F.nullif(F.array_join(F.transform("xs", lambda x: x["l"]), "\n"),
                                                     F.lit("")), F.lit(words["nothing"])).alias("t"))
        parts.append(F.concat(F.lit(f"\n== {words[b]} ==\n"), lines.scalar()))
    header = F.concat(F.lit(words["title"] + " "), since, F.lit(" .. "), F.lit(as_of),
                      F.lit(f"\n{words['total']}: "), F.col("total").cast("string"),
                      F.lit(f"\n{words['platforms']}: "), F.coalesce(plat.scalar(), F.lit("")),
                      F.lit(f"\n{words['critical']}: "), F.col("critical").cast("string"), F.lit("\n"))
    return tot.where(is_digest_day(as_of, force)).select(F.concat(header, *parts).alias("text"))
