"""Registered queries over mention rows: gates, dedup, unions, sentiment, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DIGEST_DAYS, DIGEST_SNIPPET, DRIVER_AS_OF, DRIVER_PROFILE, LLM_SENTIMENTS,
                      REPORT_SNIPPET, SENTIMENT_LABELS, TOPICS)
from ..functions.text import WHITESPACE_RE, combined_text, first_nonempty, sentiment_text
from ..operators import gates
from ..operators.dedup import dedup_first
from ..operators.reports import global_rank, newest_first_order, rank_by
from ..operators.rollups import (DIGEST_WORDS, alert_status, breakdown_share, count_by, count_by_sentiment,
                                 daily_counts, digest_samples, digest_text, meta_rollup, sentiment_trend)
from ..operators.sentiment import lexicon_sentiment, lexicon_table
from ..operators.classify import sanitise
from ..session import materialise, prepare
from ..sources.driver import duck_split_words, mentions, mentions_sql
from .registry import query

M = f"WITH mentions AS ({mentions_sql()})"
P = DRIVER_PROFILE
AS_OF = DRIVER_AS_OF
_COMB = "concat_ws(' ', nullif(title, ''), nullif(text, ''))"
_WS = WHITESPACE_RE[:-1].replace("\\x85", "\\x{85}")


def _m(spark, sf_dir) -> DataFrame:
    prepare(spark)
    return mentions(spark, sf_dir)


def _contains_any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"position('{w}' IN {expr}) > 0" for w in words) + ")"


def _strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


# --- P1 / P2 ------------------------------------------------------------------------
@query("combined_text", f"{M} SELECT platform, id, {_COMB} AS combined FROM mentions")
def q_combined_text(spark, sf_dir):
    return _m(spark, sf_dir).select("platform", "id", combined_text("title", "text").alias("combined"))


@query("sentiment_text", f"""{M}
SELECT platform, id, CASE WHEN platform = 'reddit'
  THEN {_strip_sql("coalesce(title, '') || ' ' || coalesce(text, '')")} ELSE coalesce(text, '') END AS stext
FROM mentions""")
def q_sentiment_text(spark, sf_dir):
    return _m(spark, sf_dir).select("platform", "id", sentiment_text().alias("stext"))


# --- F1 / F2 gates -------------------------------------------------------------------
_FULL = "lower(coalesce(title, '') || ' ' || coalesce(text, ''))"


@query("relevance_gate", f"""{M}
SELECT platform, id FROM mentions WHERE position('{P.brand}' IN {_FULL}) > 0
  AND NOT {_contains_any_sql(_FULL, P.blocklist)} AND {_contains_any_sql(_FULL, P.keywords)}""")
def q_relevance_gate(spark, sf_dir):
    return _m(spark, sf_dir).where(gates.relevance_gate(P)).select("platform", "id")


@query("relevance_gate_two_rule", f"""{M}
SELECT platform, id FROM mentions WHERE position('{P.brand}' IN lower(coalesce(text, ''))) > 0
  AND NOT {_contains_any_sql("lower(coalesce(text, ''))", P.blocklist)}""")
def q_relevance_gate_two_rule(spark, sf_dir):
    m = _m(spark, sf_dir)
    return m.where(gates.relevance_gate(P, title=F.lit(""), text="text", require_keywords=False)) \
        .select("platform", "id")


# --- F3 look-back ---------------------------------------------------------------------
_SINCE = f"(DATE '{AS_OF}' - INTERVAL {DIGEST_DAYS} DAY)"


@query("lookback_7d", f"{M} SELECT platform, id, event_time FROM mentions WHERE event_time >= {_SINCE}")
def q_lookback_7d(spark, sf_dir):
    return _m(spark, sf_dir).where(gates.lookback(AS_OF)).select("platform", "id", "event_time")


# --- landed batches (stand-in input for dedup / union / append) -----------------------
_REFETCH_FROM = "2024-01-10"
_LATER = 1_000_000_000_000


def _landed(m: DataFrame) -> DataFrame:
    """All mentions as landed first, plus a later re-fetch of recent rows (changed text)."""
    cols = ["platform", "id", "seq", "title", "text", "event_time"]
    again = m.where(F.col("event_time") >= F.lit(_REFETCH_FROM).cast("timestamp_ntz")).select(
        "platform", "id", (F.col("seq") + F.lit(_LATER)).alias("seq"), "title",
        F.upper("text").alias("text"), "event_time")
    return m.select(*cols).unionByName(again)


_LANDED_SQL = f"""landed AS (
  SELECT platform, id, seq, title, text, event_time FROM mentions
  UNION ALL
  SELECT platform, id, seq + {_LATER}, title, upper(text), event_time FROM mentions
  WHERE event_time >= TIMESTAMP '{_REFETCH_FROM}')"""


# --- D1 / D2 ------------------------------------------------------------------------
@query("dedup_first", f"""{M}, {_LANDED_SQL}
SELECT platform, id, seq, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY platform, id ORDER BY seq) AS rn FROM landed) WHERE rn = 1""")
def q_dedup_first(spark, sf_dir):
    d = dedup_first(_landed(_m(spark, sf_dir)), ("platform", "id"), "seq")
    return d.select("platform", "id", "seq", F.md5("text").alias("text_md5"))


@query("dedup_then_gate", f"""{M}, {_LANDED_SQL},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, id ORDER BY seq) AS rn
                          FROM landed) WHERE rn = 1)
SELECT platform, id, seq FROM firsts WHERE position('{P.brand}' IN {_FULL}) > 0
  AND NOT {_contains_any_sql(_FULL, P.blocklist)} AND {_contains_any_sql(_FULL, P.keywords)}""")
def q_dedup_then_gate(spark, sf_dir):
    d = dedup_first(_landed(_m(spark, sf_dir)), ("platform", "id"), "seq")
    return d.where(gates.relevance_gate(P)).select("platform", "id", "seq")


# --- U1 union of differently shaped sources --------------------------------------------
def _source_slices(m: DataFrame) -> list[DataFrame]:
    """Four source-shaped frames (different column sets), as the per-source files are."""
    return [
        m.where(F.col("platform") == "reddit").select("id", "platform", "title", "text", "votes", "seq"),
        m.where(F.col("platform") == "twitter").select("id", "platform", "text", F.col("votes").alias("likes"), "seq"),
        m.where(F.col("platform") == "playstore").select("id", "platform", "text", "rating", "seq"),
        m.where(F.col("platform") == "appstore").select("id", "platform", "title", "text", "rating", "seq"),
    ]


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@query("union_sources", f"""{M}
SELECT id, platform, title, text, votes, NULL::BIGINT AS likes, NULL::INTEGER AS rating, seq FROM mentions WHERE platform = 'reddit'
UNION ALL SELECT id, platform, NULL, text, NULL, votes, NULL, seq FROM mentions WHERE platform = 'twitter'
UNION ALL SELECT id, platform, NULL, text, NULL, NULL, rating, seq FROM mentions WHERE platform = 'playstore'
UNION ALL SELECT id, platform, title, text, NULL, NULL, rating, seq FROM mentions WHERE platform = 'appstore'""")
def q_union_sources(spark, sf_dir):
    u = union_sources(_source_slices(_m(spark, sf_dir)))
    return u.select("id", "platform", "title", "text", "votes", "likes", "rating", "seq")


# --- A1 -------------------------------------------------------------------------------
@query("count_by_platform", f"""{M}
SELECT coalesce(platform, 'unknown') AS platform, count(*)::BIGINT AS n FROM mentions GROUP BY 1""")
def q_count_by_platform(spark, sf_dir):
    return count_by(_m(spark, sf_dir), "platform", "unknown", "platform")


# --- V1 / V2 / A2 lexicon sentiment ---------------------------------------------------
# Driver lexicon: invented words of the driver text with our own valences.
DRIVER_LEXICON = {"orre": 1.8, "hehely": 2.4, "inoran": 1.1, "thre": 0.9, "erin": 1.5,
                  "rewh": -2.2, "ononst": -1.4, "thon": -0.8, "thth": -1.7, "ther": -0.5}
DRIVER_NEGATORS = ("not", "th")
DRIVER_BOOSTERS = {"ly": 0.293, "ble": -0.293}


def _lexicon_sql() -> str:
    words = sorted(set(DRIVER_LEXICON) | set(DRIVER_NEGATORS) | set(DRIVER_BOOSTERS))
    vals = ", ".join(f"('{w}', {float(DRIVER_LEXICON.get(w, 0.0))}, {1 if w in DRIVER_NEGATORS else 0}, "
                     f"{float(DRIVER_BOOSTERS.get(w, 0.0))})" for w in words)
    return f"lx(word, valence, neg, boost) AS (VALUES {vals})"


def _sentiment_sql_ctes() -> str:
    st = "CASE WHEN platform = 'reddit' THEN " + _strip_sql("coalesce(title, '') || ' ' || coalesce(text, '')") + \
         " ELSE coalesce(text, '') END"
    part = "PARTITION BY platform, id ORDER BY pos"
    return f"""{_lexicon_sql()},
tk AS (SELECT platform, id, {_strip_sql(st)} = '' AS blank, list_prepend(NULL, {duck_split_words(st)}) AS tok FROM mentions),
ex AS (SELECT platform, id, blank, len(tok) - 1 AS n, unnest(tok) AS word, generate_subscripts(tok, 1) - 1 AS pos FROM tk),
hits AS (SELECT ex.*, lx.valence, lx.neg, lx.boost FROM ex LEFT JOIN lx USING (word)
         WHERE ex.pos = 0 OR lx.valence IS NOT NULL),
wd AS (SELECT *,
  coalesce(sum(boost) OVER ({part} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) * 1.0
  + coalesce(sum(boost) OVER ({part} RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING), 0) * 0.95
  + coalesce(sum(boost) OVER ({part} RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0) * 0.9 AS b,
  coalesce(max(neg) OVER ({part} RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) > 0 AS negated FROM hits),
sc AS (SELECT *, CASE WHEN pos = 0 THEN NULL ELSE
  (CASE WHEN valence > 0 THEN valence + b WHEN valence < 0 THEN valence - b ELSE valence END)
  * (CASE WHEN negated THEN -0.74 ELSE 1.0 END) END AS v FROM wd),
ag AS (SELECT platform, id, bool_or(blank) AS blank, max(n) AS n, coalesce(sum(v), 0.0) AS s,
  coalesce(sum(v + 1.0) FILTER (WHERE v > 0), 0.0) AS ps, coalesce(sum(v - 1.0) FILTER (WHERE v < 0), 0.0) AS ns,
  count(*) FILTER (WHERE v <> 0) AS nz FROM sc GROUP BY platform, id),
sen AS (SELECT platform, id, blank, s / sqrt(s * s + 15.0) AS c,
  ps + abs(ns) + (n - nz) AS total, ps, ns, (n - nz)::DOUBLE AS neu FROM ag),
lab AS (SELECT platform, id,
  CASE WHEN blank THEN 'neutral' WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN blank THEN 0.0 ELSE round(c, 4) END AS compound,
  CASE WHEN blank THEN 0.0 WHEN total > 0 THEN round(abs(ps) / total, 4) ELSE 0.0 END AS pos,
  CASE WHEN blank THEN 1.0 WHEN total > 0 THEN round(neu / total, 4) ELSE 0.0 END AS neu,
  CASE WHEN blank THEN 0.0 WHEN total > 0 THEN round(abs(ns) / total, 4) ELSE 0.0 END AS neg FROM sen)"""


def _sentiment(spark, m: DataFrame, keep=()) -> DataFrame:
    lex = lexicon_table(spark, DRIVER_LEXICON, DRIVER_NEGATORS, DRIVER_BOOSTERS)
    return lexicon_sentiment(m, lex, ("platform", "id"), sentiment_text(), keep=keep)


@query("lexicon_sentiment", f"{M}, {_sentiment_sql_ctes()} SELECT * FROM lab")
def q_lexicon_sentiment(spark, sf_dir):
    return _sentiment(spark, _m(spark, sf_dir))


@query("sentiment_label", f"{M}, {_sentiment_sql_ctes()} SELECT platform, id, label FROM lab")
def q_sentiment_label(spark, sf_dir):
    return _sentiment(spark, _m(spark, sf_dir)).select("platform", "id", "label")


@query("count_by_sentiment", f"""{M}, {_sentiment_sql_ctes()},
spine(label) AS (VALUES {", ".join(f"('{x}')" for x in SENTIMENT_LABELS)})
SELECT spine.label, count(lab.id)::BIGINT AS n FROM spine LEFT JOIN lab USING (label) GROUP BY spine.label""")
def q_count_by_sentiment(spark, sf_dir):
    return count_by_sentiment(_sentiment(spark, _m(spark, sf_dir)))


# --- C5 sanitise + A3 / F4 / F8 / K1 --------------------------------------------------
def _sanitised(m: DataFrame) -> DataFrame:
    return m.select("*", *sanitise(F.col("raw_relevance"), F.col("raw_topic"), F.col("raw_sentiment"),
                                   F.col("raw_phrases")))


def sanitise_exprs_sql(rel: str, topic: str, sent: str, phrases: str) -> str:
    """DuckDB select list: relevance, topic, llm_sentiment, key_phrases, is_critical."""
    d = f"TRY_CAST({rel} AS DOUBLE)"
    r = (f"(CASE WHEN {d} IS NULL OR isnan({d}) OR isinf({d}) THEN 5 ELSE "
         f"CAST(trunc(greatest(0.0, least(10.0, {d}))) AS INTEGER) END)")
    tp, sp = _strip_sql(topic), _strip_sql(sent)
    t0 = (f"(CASE WHEN lower({tp}) IN ({', '.join(repr(t) for t in TOPICS)}) "
          f"THEN lower({tp}) ELSE 'general' END)")
    t = f"(CASE WHEN {r} < 7 THEN 'irrelevant' ELSE {t0} END)"
    se = (f"(CASE WHEN lower({sp}) IN ({', '.join(repr(t) for t in LLM_SENTIMENTS)}) "
          f"THEN lower({sp}) ELSE 'mixed' END)")
    return (f"{r} AS relevance, {t} AS topic, {se} AS llm_sentiment, "
            f"coalesce(list_slice({phrases}, 1, 3), []) AS key_phrases, "
            f"({t} = 'bug_report' AND {se} = 'very_negative') AS is_critical")


def _sanitise_sql() -> str:
    return f"""san AS (SELECT *, {sanitise_exprs_sql('raw_relevance', 'raw_topic', 'raw_sentiment', 'raw_phrases')}
             FROM mentions)"""


@query("sanitise_labels", f"""{M}, {_sanitise_sql()}
SELECT platform, id, relevance, topic, llm_sentiment, key_phrases, is_critical FROM san""")
def q_sanitise_labels(spark, sf_dir):
    return _sanitised(_m(spark, sf_dir)).select("platform", "id", "relevance", "topic", "llm_sentiment",
                                                 "key_phrases", "is_critical")


@query("count_by_topic", f"""{M}, {_sanitise_sql()}
SELECT coalesce(topic, 'general') AS topic, count(*)::BIGINT AS n FROM san GROUP BY 1""")
def q_count_by_topic(spark, sf_dir):
    return count_by(_sanitised(_m(spark, sf_dir)), "topic", "general", "topic")


@query("critical_alerts", f"""{M}, {_sanitise_sql()}
SELECT platform, id, event_time, relevance, topic, llm_sentiment FROM san WHERE is_critical""")
def q_critical_alerts(spark, sf_dir):
    s = _sanitised(_m(spark, sf_dir))
    return s.where(gates.is_critical()).select("platform", "id", "event_time", "relevance", "topic",
                                               "llm_sentiment")


@query("relevant_only", f"{M}, {_sanitise_sql()} SELECT platform, id, relevance FROM san WHERE relevance >= 7")
def q_relevant_only(spark, sf_dir):
    return _sanitised(_m(spark, sf_dir)).where(gates.relevant_only()).select("platform", "id", "relevance")


@query("alert_status", f"""{M}, {_sanitise_sql()}
SELECT count(*) FILTER (WHERE is_critical)::BIGINT AS critical,
       CASE WHEN count(*) FILTER (WHERE is_critical) > 0
            THEN 'CRITICAL:' || count(*) FILTER (WHERE is_critical) ELSE 'OK' END AS status FROM san""")
def q_alert_status(spark, sf_dir):
    return alert_status(_sanitised(_m(spark, sf_dir)))


# --- A4 / A5 meta roll-up (one pass, grouping sets) ----------------------------------
@query("meta_rollup", f"""{M}, {_sentiment_sql_ctes()}, {_sanitise_sql()},
j AS (SELECT s.platform, s.topic, s.is_critical, l.label FROM san s JOIN lab l USING (platform, id))
SELECT 'total' AS dimension, '' AS key, count(*)::BIGINT AS n FROM j
UNION ALL SELECT 'critical', '', count(*) FILTER (WHERE is_critical) FROM j
UNION ALL SELECT 'platform', coalesce(platform, 'unknown'), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'topic', coalesce(topic, 'general'), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'sentiment', s.label, count(j.label) FROM (VALUES ('positive'), ('neutral'), ('negative')) s(label)
  LEFT JOIN j ON j.label = s.label GROUP BY 2""")
def q_meta_rollup(spark, sf_dir):
    s = _sanitised(_m(spark, sf_dir))
    return meta_rollup(_sentiment(spark, s, keep=("topic", "is_critical")))


# --- O1 newest first --------------------------------------------------------------
@query("newest_first", f"""{M}
SELECT platform, id, event_time, row_number() OVER (ORDER BY event_time DESC NULLS LAST, seq) AS rnk FROM mentions""")
def q_newest_first(spark, sf_dir):
    m = _m(spark, sf_dir).select("platform", "id", "event_time", "seq")
    return global_rank(m, newest_first_order()).select("platform", "id", "event_time", "rnk")


# --- S13 platform report ---------------------------------------------------------------
@query("platform_report", f"""{M}, {_sanitise_sql()}
SELECT platform, id, relevance, topic,
       substring(coalesce(nullif(title, ''), nullif(text, ''), ''), 1, {REPORT_SNIPPET}) AS snippet
FROM san WHERE platform = 'reddit'""")
def q_platform_report(spark, sf_dir):
    s = _sanitised(_m(spark, sf_dir)).where(F.col("platform") == "reddit")
    return s.select("platform", "id", "relevance", "topic",
                    F.substring(F.coalesce(first_nonempty("title", "text"), F.lit("")), 1, REPORT_SNIPPET)
                    .alias("snippet"))


# --- A10 / A11 / A12 / W3 dashboard series -----------------------------------------------
@query("daily_mentions", f"""{M}
SELECT platform, CAST(event_time AS DATE) AS day, count(*)::BIGINT AS n FROM mentions GROUP BY 1, 2""")
def q_daily_mentions(spark, sf_dir):
    return daily_counts(_m(spark, sf_dir), ["platform"])


@query("rating_trend", f"""{M}
SELECT CAST(event_time AS DATE) AS day, round(avg(rating), 4) AS avg_rating, count(*)::BIGINT AS n
FROM mentions WHERE platform = 'playstore' GROUP BY 1""")
def q_rating_trend(spark, sf_dir):
    m = _m(spark, sf_dir).where(F.col("platform") == "playstore")
    return m.groupBy(F.to_date("event_time").alias("day")).agg(
        F.round(F.avg("rating"), 4).alias("avg_rating"), F.count(F.lit(1)).cast("bigint").alias("n"))


@query("breakdown_share", f"""{M}, {_sanitise_sql()},
b AS (SELECT 'platform' AS dimension, coalesce(platform, 'unknown') AS key, count(*) AS n FROM san GROUP BY 2
      UNION ALL SELECT 'topic', coalesce(topic, 'general'), count(*) FROM san GROUP BY 2)
SELECT dimension, key, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM b""")
def q_breakdown_share(spark, sf_dir):
    return breakdown_share(_sanitised(_m(spark, sf_dir)), {"platform": "unknown", "topic": "general"})


@query("sentiment_trend_7d", f"""{M}, {_sentiment_sql_ctes()},
d AS (SELECT CAST(m.event_time AS DATE) AS day, l.label FROM mentions m JOIN lab l USING (platform, id)),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
grid AS (SELECT day, label FROM spine, (VALUES ('positive'), ('neutral'), ('negative')) s(label)),
cnt AS (SELECT day, label, count(*) AS n FROM d GROUP BY ALL),
z AS (SELECT g.day, g.label, coalesce(c.n, 0)::BIGINT AS n FROM grid g LEFT JOIN cnt c USING (day, label))
SELECT day, label, n, round(avg(n) OVER (PARTITION BY label ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg_7d FROM z""")
def q_sentiment_trend_7d(spark, sf_dir):
    d = _sentiment(spark, _m(spark, sf_dir), keep=("event_time",))
    return sentiment_trend(d, SENTIMENT_LABELS, days=7)


# --- A13 / W1 / T1 digest ---------------------------------------------------------
@query("digest_stats", f"""{M}, {_sanitise_sql()},
w AS (SELECT * FROM san WHERE event_time >= {_SINCE})
SELECT 'total' AS dimension, '' AS key, count(*)::BIGINT AS n FROM w
UNION ALL SELECT 'critical', '', count(*) FILTER (WHERE is_critical) FROM w
UNION ALL SELECT 'platform', coalesce(platform, 'unknown'), count(*) FROM w GROUP BY 2""")
def q_digest_stats(spark, sf_dir):
    w = _sanitised(_m(spark, sf_dir)).where(gates.lookback(AS_OF))
    return meta_rollup(w, dims={"platform": "unknown"}, sentiment=False)


@query("digest_samples", f"""{M}, {_sanitise_sql()},
w AS (SELECT * FROM san WHERE event_time >= {_SINCE}),
b AS (SELECT 'negative' AS bucket, 10 AS k, * FROM w WHERE llm_sentiment IN ('very_negative', 'negative')
      UNION ALL SELECT 'positive', 10, * FROM w WHERE llm_sentiment IN ('very_positive', 'positive')
      UNION ALL SELECT 'bug', 5, * FROM w WHERE topic = 'bug_report'
      UNION ALL SELECT 'feature', 5, * FROM w WHERE topic = 'feature_request'),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_time DESC NULLS LAST, seq) AS rn FROM b)
SELECT bucket, rn::BIGINT AS rn, platform, id,
       substring(coalesce(nullif(title, ''), nullif(text, ''), ''), 1, {DIGEST_SNIPPET}) AS snippet
FROM r WHERE rn <= k""")
def q_digest_samples(spark, sf_dir):
    w = _sanitised(_m(spark, sf_dir)).where(gates.lookback(AS_OF))
    return digest_samples(w, newest_first_order()).select("bucket", "rn", "platform", "id", "snippet")


# --- O3 top engagement ---------------------------------------------------------------
@query("top_engagement", f"""{M}
SELECT platform, id, votes, rnk FROM (
  SELECT platform, id, votes, row_number() OVER (ORDER BY votes DESC, seq) AS rnk FROM mentions) WHERE rnk <= 15""")
def q_top_engagement(spark, sf_dir):
    m = _m(spark, sf_dir)
    return rank_by(m, [F.col("votes").desc(), F.col("seq").asc()], limit=15).select(
        "platform", "id", "votes", "rnk")


# --- T1 / S12 weekly digest text ------------------------------------------------------
def _digest_sql() -> str:
    def bucket(b: str, title: str) -> str:
        return (f"'\n== {title} ==\n' || coalesce((SELECT string_agg('- ' || snippet, chr(10) ORDER BY rn) "
                f"FROM samp WHERE bucket = '{b}'), '{DIGEST_WORDS['nothing']}')")
    return f"""{M}, {_sanitise_sql()},
w AS (SELECT * FROM san WHERE event_time >= {_SINCE}),
b AS (SELECT 'negative' AS bucket, 10 AS k, * FROM w WHERE llm_sentiment IN ('very_negative', 'negative')
      UNION ALL SELECT 'positive', 10, * FROM w WHERE llm_sentiment IN ('very_positive', 'positive')
      UNION ALL SELECT 'bug', 5, * FROM w WHERE topic = 'bug_report'
      UNION ALL SELECT 'feature', 5, * FROM w WHERE topic = 'feature_request'),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_time DESC NULLS LAST, seq) AS rn FROM b),
samp AS (SELECT bucket, rn, substring(coalesce(nullif(title, ''), nullif(text, ''), ''), 1, {DIGEST_SNIPPET}) AS snippet
         FROM r WHERE rn <= k),
pl AS (SELECT string_agg(p || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY p || ': ' || CAST(n AS VARCHAR)) AS s
       FROM (SELECT coalesce(platform, 'unknown') AS p, count(*) AS n FROM w GROUP BY 1))
SELECT '{DIGEST_WORDS['title']} ' || strftime(DATE '{AS_OF}' - INTERVAL {DIGEST_DAYS} DAY, '%Y-%m-%d') || ' .. {AS_OF}'
  || chr(10) || '{DIGEST_WORDS['total']}: ' || (SELECT count(*) FROM w)
  || chr(10) || '{DIGEST_WORDS['platforms']}: ' || coalesce((SELECT s FROM pl), '')
  || chr(10) || '{DIGEST_WORDS['critical']}: ' || (SELECT count(*) FILTER (WHERE is_critical) FROM w) || chr(10)
  || {' || '.join(bucket(b, DIGEST_WORDS[b]) for b in ('negative', 'positive', 'bug', 'feature'))} AS text"""


@query("weekly_digest", _digest_sql())
def q_weekly_digest(spark, sf_dir):
    # the week's rows are read three times below, the documents once
    w = materialise(_sanitised(_m(spark, sf_dir)).where(gates.lookback(AS_OF)), "digest-week")
    stats = meta_rollup(w, dims={"platform": "unknown"}, sentiment=False)
    samples = digest_samples(w, newest_first_order())
    return digest_text(stats, samples, AS_OF, DIGEST_DAYS)


# --- O4 browse sorted by most negative lexicon sentiment ----------------------------------
@query("browse_most_negative", f"""{M}, {_sentiment_sql_ctes()}
SELECT platform, id, compound, rnk FROM (
  SELECT m.platform, m.id, l.compound, row_number() OVER (ORDER BY l.compound ASC NULLS LAST, m.seq) AS rnk
  FROM mentions m JOIN lab l USING (platform, id)
  WHERE m.event_time >= {_SINCE} AND m.platform = 'twitter')""")
def q_browse_most_negative(spark, sf_dir):
    from ..operators.browse import browse
    # filters first, then scores, so only the rows that are shown are scored
    m = _m(spark, sf_dir).where((F.col("platform") == "twitter") & gates.lookback(AS_OF, DIGEST_DAYS))
    b = browse(_sentiment(spark, m, keep=("seq", "event_time")), sort="most_negative")
    return b.select("platform", "id", "compound", "rnk")


# --- O4 browse: happy posts of a range of days, happiest first ------------------------------
@query("browse_most_positive", f"""{M}, {_sentiment_sql_ctes()}
SELECT platform, id, compound, rnk FROM (
  SELECT m.platform, m.id, l.compound, row_number() OVER (ORDER BY l.compound DESC NULLS LAST, m.seq) AS rnk
  FROM mentions m JOIN lab l USING (platform, id)
  WHERE CAST(m.event_time AS DATE) <= DATE '{AS_OF}' - INTERVAL 2 DAY AND l.label = 'positive')""")
def q_browse_most_positive(spark, sf_dir):
    from ..operators.browse import browse
    import datetime as dt
    until = str(dt.date.fromisoformat(AS_OF) - dt.timedelta(days=2))
    s = _sentiment(spark, _m(spark, sf_dir), keep=("seq", "event_time"))
    b = browse(s, until=until, sentiment="positive", sort="most_positive")
    return b.select("platform", "id", "compound", "rnk")
