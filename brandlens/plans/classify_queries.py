"""Registered queries: batches, prompts, model answers, incremental enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DRIVER_AS_OF, DRIVER_PROFILE, MAX_PROMPT_TEXT
from ..functions.text import WHITESPACE_RE
from ..operators.classify import (DEFAULT_ITEM, assign_batches, batch_prompts, cache_admission, call_model,
                                  incremental_overlay, parse_answers, sanitise,
                                  sanitise_answer, zip_batch_results)
from ..operators.dedup import append_unseen
from ..operators.enrich import enrich_incremental
from ..operators.reports import newest_first_order
from ..session import prepare
from ..sources.driver import mentions, mentions_sql
from .mention_queries import _LANDED_SQL, _landed, _sanitise_sql, sanitise_exprs_sql
from .registry import query
from .stand_ins import stand_in_model

M = f"WITH mentions AS ({mentions_sql()})"
P = DRIVER_PROFILE
AS_OF = DRIVER_AS_OF
_WS = WHITESPACE_RE[:-1].replace("\\x85", "\\x{85}")
_ORDER_SQL = "event_time DESC NULLS LAST, seq"


def _m(spark, sf_dir) -> DataFrame:
    prepare(spark)
    return mentions(spark, sf_dir)


def _strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


# --- C1 / W2 batches of 5 in newest-first order --------------------------------------
@query("batch_assign", f"""{M}
SELECT platform, id, ((row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) // 5)::BIGINT AS batch_id,
       ((row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) % 5)::INTEGER AS pos_in_batch FROM mentions""")
def q_batch_assign(spark, sf_dir):
    keys = _m(spark, sf_dir).select("platform", "id", "event_time", "seq")
    return assign_batches(keys, newest_first_order()).select("platform", "id", "batch_id", "pos_in_batch")


# --- P3 / C2 prompts (template = our own text; compared on the item block) ------------
_ITEM_TEMPLATE = "{items}"
_ITEM_FMT = DEFAULT_ITEM.replace("\n", "\\n")


@query("batch_prompts", f"""{M},
b AS (SELECT *, (row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) // 5 AS batch_id,
             (row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) % 5 AS pos FROM mentions),
it AS (SELECT batch_id, pos, printf(E'{_ITEM_FMT}', pos + 1, coalesce(platform, 'unknown'),
       substring({_strip_sql("coalesce(title, '') || ' ' || coalesce(text, '')")}, 1, {MAX_PROMPT_TEXT})) AS item FROM b)
SELECT batch_id::BIGINT AS batch_id, count(*)::INTEGER AS n, string_agg(item, chr(10) ORDER BY pos) AS prompt
FROM it GROUP BY batch_id""")
def q_batch_prompts(spark, sf_dir):
    return batch_prompts(_batched(spark, sf_dir), template=_ITEM_TEMPLATE)


# --- stand-in model responses (from the tables) with the malformations C4 must handle ----
def _responses(batched: DataFrame) -> DataFrame:
    """One response text per batch, built from the rows' raw answer columns.

    Depending on batch_id the JSON array is returned clean, fenced, wrapped in prose,
    truncated, missing, short, or as a bare object, so every parser level runs.
    """
    ans = F.struct(F.col("raw_relevance").alias("relevance"), F.col("raw_topic").alias("topic"),
                   F.col("raw_sentiment").alias("llm_sentiment"), F.col("raw_phrases").alias("key_phrases"))
    g = batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos_in_batch", ans.alias("a")))).alias("_xs"))
    arr = F.to_json(F.transform("_xs", lambda x: x["a"]))
    first = F.to_json(F.element_at(F.transform("_xs", lambda x: x["a"]), 1))
    k = F.pmod(F.col("batch_id"), F.lit(10))
    resp = (F.when(k == 0, arr)
            .when(k == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here you go: "), arr, F.lit(" hope it helps")))
            .when(k == 3, F.expr("substring(to_json(transform(_xs, x -> x.a)), 1, "
                                 "length(to_json(transform(_xs, x -> x.a))) - 12)"))
            .when(k == 4, F.lit("no answer"))
            .when(k == 5, F.concat(F.lit("["), first, F.lit("]")))
            .when(k == 6, F.concat(F.lit("[1] "), arr))
            .when(k == 7, F.concat(F.lit("["), first, F.lit("] and ["), first, F.lit("]")))
            .when(k == 8, F.translate(arr, '"', "'"))
            .otherwise(first))
    return g.select("batch_id", "n", resp.alias("response"))


def _batched(spark, sf_dir) -> DataFrame:
    m = _m(spark, sf_dir).select("platform", "id", "event_time", "seq", "title", "text", "raw_relevance",
                                 "raw_topic", "raw_sentiment", "raw_phrases")
    return assign_batches(m, newest_first_order())


# --- C4 parse (golden cases are unit-tested too) ----------------------------------------
_FENCE = "`" * 3
_OBJ_RE = r"\{[^{}]+\}"


def _responses_sql() -> str:
    """DuckDB twin of `_responses` (same stand-in texts) plus the 4-level parse."""
    ans = ("{'relevance': raw_relevance, 'topic': raw_topic, 'llm_sentiment': raw_sentiment, "
           "'key_phrases': raw_phrases}")
    strip = lambda e: _strip_sql(e)
    return f"""{M},
b AS (SELECT *, (row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) // 5 AS batch_id,
             (row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) % 5 AS pos FROM mentions),
g AS (SELECT batch_id, count(*)::INTEGER AS n, CAST(to_json(list({ans} ORDER BY pos)) AS VARCHAR) AS arr,
             CAST(to_json(list({ans} ORDER BY pos)[1]) AS VARCHAR) AS first FROM b GROUP BY batch_id),
resp AS (SELECT batch_id, n, CASE batch_id % 10
    WHEN 0 THEN arr WHEN 1 THEN '{_FENCE}json' || chr(10) || arr || chr(10) || '{_FENCE}'
    WHEN 2 THEN 'Here you go: ' || arr || ' hope it helps' WHEN 3 THEN substring(arr, 1, length(arr) - 12)
    WHEN 4 THEN 'no answer' WHEN 5 THEN '[' || first || ']'
    WHEN 6 THEN '[1] ' || arr WHEN 7 THEN '[' || first || '] and [' || first || ']'
    WHEN 8 THEN translate(arr, '"', chr(39)) ELSE first END AS response FROM g),
t0 AS (SELECT batch_id, n, {strip(f"regexp_replace(regexp_replace({strip('response')}, '(?m)^{_FENCE}[a-z]*\n?', '', 'g'), '(?m)\n?{_FENCE}$', '', 'g')")} AS t FROM resp),
t1 AS (SELECT *, strpos(t, '[') AS lb, strpos(reverse(t), ']') AS rr FROM t0),
t2 AS (SELECT *, CASE WHEN lb > 0 AND rr > 0 AND length(t) - rr + 1 > lb
                      THEN substring(t, lb, length(t) - rr + 1 - lb + 1) END AS sliced FROM t1),
t3 AS (SELECT *, CASE WHEN json_valid(sliced) AND json_type(CAST(sliced AS JSON)) = 'ARRAY'
                      THEN CAST(sliced AS JSON[]) END AS arr_el,
              list_filter(regexp_extract_all(t, '{_OBJ_RE}'), lambda e: json_valid(e)) AS rec FROM t2),
t4 AS (SELECT batch_id, n, CASE WHEN arr_el IS NOT NULL THEN list_transform(arr_el, lambda e: CAST(e AS VARCHAR))
                           WHEN len(rec) > 0 THEN rec ELSE [] END AS chosen FROM t3),
t5 AS (SELECT batch_id, n, list_slice(chosen, 1, n) AS head FROM t4),
t6 AS (SELECT batch_id, n, CASE WHEN len(list_filter(head, lambda e: json_type(CAST(e AS JSON)) <> 'OBJECT')) > 0
                           THEN [] ELSE head END AS head FROM t5),
ex AS (SELECT batch_id, n, p.pos - 1 AS pos, head[p.pos] AS e FROM t6, generate_series(1, n) AS p(pos))"""


@query("parse_responses", _responses_sql() + """
SELECT batch_id, pos::INTEGER AS pos, json_extract_string(e, '$.relevance') AS relevance,
       json_extract_string(e, '$.topic') AS topic, json_extract_string(e, '$.llm_sentiment') AS llm_sentiment FROM ex""")
def q_parse_responses(spark, sf_dir):
    r = _responses(_batched(spark, sf_dir))
    p = r.select("batch_id", "n", parse_answers(F.col("response"), F.col("n")).alias("answers"))
    return p.select("batch_id", "n", F.posexplode("answers").alias("pos", "answer")).select(
        "batch_id", F.col("pos").cast("int").alias("pos"), F.col("answer")["relevance"].alias("relevance"),
        F.col("answer")["topic"].alias("topic"), F.col("answer")["llm_sentiment"].alias("llm_sentiment"))


# --- J5 positional zip + C5 on parsed answers ---------------------------------------
_KP = "json_extract(e, '$.key_phrases')"
_KP_LIST = (f"CASE WHEN json_type({_KP}) = 'ARRAY' THEN json_transform({_KP}, '[\"VARCHAR\"]') END")


@query("zip_batch_results", _responses_sql() + f""",
z AS (SELECT b.platform, b.id, b.batch_id::BIGINT AS batch_id, b.pos::INTEGER AS pos_in_batch, ex.e
      FROM b LEFT JOIN ex ON ex.batch_id = b.batch_id AND ex.pos = b.pos)
SELECT platform, id, batch_id, pos_in_batch, {sanitise_exprs_sql("json_extract_string(e, '$.relevance')",
    "json_extract_string(e, '$.topic')", "json_extract_string(e, '$.llm_sentiment')", _KP_LIST)} FROM z""")
def q_zip_batch_results(spark, sf_dir):
    b = _batched(spark, sf_dir)
    r = _responses(b)
    ans = r.select("batch_id", parse_answers(F.col("response"), F.col("n")).alias("answers"))
    z = zip_batch_results(b, ans)
    return z.select("platform", "id", "batch_id", "pos_in_batch", *sanitise_answer(F.col("answer")))


# --- C3 model call through mapInPandas (offline deterministic model) -----------------
def _classify_sql(m: str = M) -> str:
    """The offline model's rules in SQL, applied to the same prompt item bodies."""
    joined = "coalesce(title, '') || ' ' || coalesce(text, '')"
    body = f"substring({_strip_sql(joined)}, 1, {MAX_PROMPT_TEXT})"
    words = f"list_filter(regexp_split_to_array(lower(body), '{_WS}+'), lambda x: x <> '')"
    return f"""{m},
b AS (SELECT *, (row_number() OVER (ORDER BY {_ORDER_SQL}) - 1) // 5 AS batch_id FROM mentions),
it AS (SELECT platform, id, batch_id, {body} AS body FROM b),
wd AS (SELECT *, {words} AS words FROM it),
mo AS (SELECT platform, id, batch_id, CAST(least(10, len(words) // 8) AS VARCHAR) AS rel,
         CASE WHEN len(list_filter(words, lambda w: starts_with(w, 'crash') OR starts_with(w, 'bug')
                                            OR starts_with(w, 'error'))) > 0 THEN 'bug_report'
              WHEN right(regexp_replace(body, '{_WS}+$', ''), 1) = '?' THEN 'question' ELSE 'general' END AS top,
         list_slice(list_sort(list_distinct(list_filter(words, lambda w: length(w) > 6))), 1, 3) AS kp FROM wd)
SELECT platform, id, batch_id::BIGINT AS batch_id,
       {sanitise_exprs_sql("rel", "top", "CASE WHEN top = 'bug_report' THEN 'negative' ELSE 'mixed' END", "kp")}
FROM mo"""


@query("classify_batches", _classify_sql())
def q_classify_batches(spark, sf_dir):
    b = _batched(spark, sf_dir)
    prompts = batch_prompts(b)
    resp = call_model(prompts, stand_in_model)
    ans = resp.select("batch_id", parse_answers(F.col("response"), F.col("n")).alias("answers"))
    z = zip_batch_results(b, ans)
    return z.select("platform", "id", "batch_id", *sanitise_answer(F.col("answer")))


# --- J3 cache admission / J2 overlay / C6 incremental enrichment ----------------------
_PREV_BEFORE = "2024-01-12"


def _previous_run(m: DataFrame) -> DataFrame:
    """Enriched output of an earlier run: rows seen before the cut-off, sanitised answers."""
    old = m.where(F.col("event_time") < F.lit(_PREV_BEFORE).cast("timestamp_ntz"))
    return old.select("platform", "id", "seq", "title", "text", "event_time", "votes",
                      *sanitise(F.col("raw_relevance"), F.col("raw_topic"), F.col("raw_sentiment"),
                                F.col("raw_phrases")))


_PREV_SQL = f"""{_sanitise_sql()},
prev AS (SELECT platform, id, seq, title, text, event_time, votes, relevance, topic, llm_sentiment,
                key_phrases, is_critical FROM san WHERE event_time < TIMESTAMP '{_PREV_BEFORE}'),
cache AS (SELECT * FROM prev WHERE coalesce(id, '') <> '' AND coalesce(topic, '') <> ''
          AND coalesce(len(key_phrases), 0) > 0)"""


@query("cache_admission", f"""{M}, {_PREV_SQL}
SELECT platform, id, topic, len(key_phrases)::INTEGER AS n_phrases FROM cache""")
def q_cache_admission(spark, sf_dir):
    c = cache_admission(_previous_run(_m(spark, sf_dir)))
    return c.select("platform", "id", "topic", F.size("key_phrases").cast("int").alias("n_phrases"))


@query("incremental_overlay", f"""{M}, {_PREV_SQL}
SELECT m.platform, m.id, c.id IS NULL AS is_new, CASE WHEN c.id IS NULL THEN m.votes + 1 ELSE c.votes END AS votes,
       c.topic AS topic, c.relevance AS relevance
FROM mentions m LEFT JOIN cache c ON c.platform = m.platform AND c.id = m.id""")
def q_incremental_overlay(spark, sf_dir):
    m = _m(spark, sf_dir)
    # the current run sees changed vote counts; cached rows must keep their old values
    cur = m.select("platform", "id", "seq", "title", "text", "event_time", (F.col("votes") + 1).alias("votes"))
    o = incremental_overlay(cur, _previous_run(m))
    return o.select("platform", "id", "is_new", "votes", "topic", "relevance")


def _incremental_sql() -> str:
    """Cached rows as they were + new rows enriched with the new rows as corpus."""
    from .search_queries import _search_enrich_sql
    m_new = (f"WITH mentions AS (SELECT * FROM ({mentions_sql()}) base WHERE NOT "
             f"(base.event_time < TIMESTAMP '{_PREV_BEFORE}' AND len(base.raw_phrases) > 0))")
    cached = f"""{M}, {_PREV_SQL}
SELECT platform, id, false AS is_new, relevance, topic, llm_sentiment, is_critical,
       NULL::DOUBLE AS bm25_score, NULL::BOOLEAN AS is_near_duplicate, NULL::BOOLEAN AS fuzzy_brand_match
FROM cache"""
    new = f"""SELECT c.platform, c.id, true AS is_new, c.relevance, c.topic, c.llm_sentiment, c.is_critical,
       s.bm25_score, s.is_near_duplicate, s.fuzzy_brand_match
FROM ({_classify_sql(m_new)}) c JOIN ({_search_enrich_sql(m_new)}) s USING (platform, id)"""
    return f"SELECT * FROM ({cached}) UNION ALL SELECT * FROM ({new})"


@query("incremental_enrich", _incremental_sql())
def q_incremental_enrich(spark, sf_dir):
    m = _m(spark, sf_dir)
    cur = m.select("platform", "id", "seq", "title", "text", "event_time", "votes")
    out, _ = enrich_incremental(cur, _previous_run(m), P, stand_in_model)
    return out.select("platform", "id", "is_new", "relevance", "topic", "llm_sentiment", "is_critical",
                      "bm25_score", "is_near_duplicate", "fuzzy_brand_match")


# --- S9 / J1 accumulate unseen rows --------------------------------------------------
@query("append_unseen", f"""{M}, {_LANDED_SQL},
existing AS (SELECT platform, id, seq, title, text, event_time FROM mentions WHERE event_time < TIMESTAMP '2024-01-10'),
new AS (SELECT * FROM landed WHERE event_time >= TIMESTAMP '2024-01-08'),
nf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, id ORDER BY seq) AS rn FROM new) WHERE rn = 1)
SELECT platform, id, seq FROM existing
UNION ALL SELECT platform, id, seq FROM nf WHERE NOT EXISTS
  (SELECT 1 FROM existing e WHERE e.platform = nf.platform AND e.id = nf.id)""")
def q_append_unseen(spark, sf_dir):
    land = _landed(_m(spark, sf_dir))
    existing = land.where(F.col("event_time") < F.lit("2024-01-10").cast("timestamp_ntz")).where(
        F.col("seq") < F.lit(1_000_000_000_000))
    new = land.where(F.col("event_time") >= F.lit("2024-01-08").cast("timestamp_ntz"))
    return append_unseen(existing, new).select("platform", "id", "seq")


# --- U2 / F5 replace one platform's slice --------------------------------------------
@query("replace_partition", f"""{M}, {_LANDED_SQL}
SELECT platform, id, seq FROM mentions WHERE platform <> 'reddit'
UNION ALL SELECT platform, id, seq FROM landed WHERE platform = 'reddit' AND seq >= 1000000000000""")
def q_replace_partition(spark, sf_dir):
    from ..operators.dedup import replace_slice
    m = _m(spark, sf_dir)
    fresh = _landed(m).where(F.col("seq") >= F.lit(1_000_000_000_000)).where(F.col("platform") == "reddit")
    return replace_slice(m.select("platform", "id", "seq"), fresh.select("platform", "id", "seq"),
                         "platform", "reddit")


# --- F7 / O4 browse: filters + sort mode -----------------------------------------------
@query("browse_mentions", f"""{M}
SELECT platform, id, event_time, rnk FROM (
  SELECT platform, id, event_time, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rnk FROM mentions
  WHERE platform = 'reddit' AND event_time >= (DATE '{AS_OF}' - INTERVAL 7 DAY)
    AND position('ering' IN lower(coalesce(title, '') || ' ' || coalesce(text, ''))) > 0)""")
def q_browse_mentions(spark, sf_dir):
    from ..operators.browse import browse
    m = _m(spark, sf_dir)
    b = browse(m, platform="reddit", search="ering", since_days=7, as_of=AS_OF, sort="newest")
    return b.select("platform", "id", "event_time", "rnk")
