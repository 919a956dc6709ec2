"""Registered queries: tokenising, BM25, term statistics, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, DRIVER_PROFILE
from ..functions.text import combined_text, tokenise, tokenise_py
from ..operators.ranking import bm25_scores, corpus_stats, term_frequencies, tfidf_vectors
from ..operators.reports import rank_by
from ..session import materialise, prepare
from ..sources.driver import duck_tokenise, mentions, mentions_sql
from .registry import query

M = f"WITH mentions AS ({mentions_sql()})"
P = DRIVER_PROFILE


def _m(spark, sf_dir):
    prepare(spark)
    return mentions(spark, sf_dir)


# the corpus of a mention is its title and its text
_COMB = "concat_ws(' ', nullif(title, ''), nullif(text, ''))"


# --- X5 tokenise -----------------------------------------------------------------
@query("tokenise", f"""{M}
SELECT platform, id, {duck_tokenise(_COMB)} AS tokens,
       len({duck_tokenise(_COMB)}) AS n_tokens
FROM mentions""")
def q_tokenise(spark, sf_dir):
    m = _m(spark, sf_dir)
    t = tokenise(combined_text("title", "text"))
    return m.select("platform", "id", t.alias("tokens"), F.size(t).cast("bigint").alias("n_tokens"))


# --- R1 BM25 -----------------------------------------------------------------------
def _bm25_sql(query_text: str, m: str = M) -> str:
    q_all = tokenise_py(query_text)
    q_unique = list(dict.fromkeys(q_all))
    qvals = ", ".join(f"('{t}', {q_all.count(t)})" for t in q_unique) or "(NULL, 0)"
    return f"""{m},
docs AS (SELECT platform, id, seq, {duck_tokenise("concat_ws(' ', nullif(title, ''), nullif(text, ''))")} AS tok
         FROM mentions),
q(term, mult) AS (VALUES {qvals}),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tok))::DOUBLE AS avgdl FROM docs),
hits AS (SELECT platform, id, u.term AS term FROM docs, unnest(tok) AS u(term)
         WHERE u.term IN (SELECT term FROM q)),
tf AS (SELECT platform, id, term, count(*)::DOUBLE AS tf FROM hits GROUP BY ALL),
df AS (SELECT term, count(DISTINCT (platform, id))::DOUBLE AS df FROM hits GROUP BY term),
sc AS (SELECT tf.platform, tf.id,
              sum(q.mult * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1)
                  * (tf.tf * {BM25_K1 + 1.0}) / (tf.tf + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * len(d.tok) / st.avgdl))) AS s
       FROM tf JOIN df USING (term) JOIN q USING (term)
       JOIN docs d ON d.platform = tf.platform AND d.id = tf.id, st
       GROUP BY ALL)
"""


@query("bm25_scores", _bm25_sql(P.reference_query) + """
SELECT d.platform, d.id, round(coalesce(sc.s, 0.0), 4) AS bm25_score
FROM docs d LEFT JOIN sc ON sc.platform = d.platform AND sc.id = d.id""")
def q_bm25_scores(spark, sf_dir):
    m = _m(spark, sf_dir)
    return bm25_scores(m, P.reference_query, keys=("platform", "id"),
                       text=combined_text("title", "text"))


# --- O2 top-10 by BM25 --------------------------------------------------------------
@query("bm25_top10", _bm25_sql(P.reference_query) + """
SELECT platform, id, bm25_score, rnk FROM (
  SELECT d.platform, d.id, round(coalesce(sc.s, 0.0), 4) AS bm25_score,
         row_number() OVER (ORDER BY round(coalesce(sc.s, 0.0), 4) DESC, d.seq) AS rnk
  FROM docs d LEFT JOIN sc ON sc.platform = d.platform AND sc.id = d.id)
WHERE rnk <= 10""")
def q_bm25_top10(spark, sf_dir):
    m = _m(spark, sf_dir)
    s = bm25_scores(m, P.reference_query, keys=("platform", "id"), keep=("seq",),
                    text=combined_text("title", "text"))
    return rank_by(s, [F.col("bm25_score").desc(), F.col("seq").asc()], limit=10).select(
        "platform", "id", "bm25_score", "rnk")


# --- A6 term frequency -------------------------------------------------------------
@query("term_freq", f"""{M},
t AS (SELECT platform, id, {duck_tokenise(_COMB)} AS tok FROM mentions)
SELECT platform, id, u.term AS term, count(*)::BIGINT AS tf, max(len(tok))::BIGINT AS dl
FROM t, unnest(tok) AS u(term) GROUP BY ALL""")
def q_term_freq(spark, sf_dir):
    m = _m(spark, sf_dir)
    tf = term_frequencies(m, ("platform", "id"), combined_text("title", "text"))
    return tf.select("platform", "id", "term", F.col("tf").cast("bigint").alias("tf"),
                     F.col("dl").cast("bigint").alias("dl"))


# --- A7 document frequency + corpus stats -----------------------------------------
@query("doc_freq", f"""{M},
t AS (SELECT platform, id, {duck_tokenise(_COMB)} AS tok FROM mentions),
st AS (SELECT count(*)::BIGINT AS n, round(avg(len(tok)), 6) AS avgdl FROM t)
SELECT u.term AS term, count(DISTINCT (platform, id))::BIGINT AS df, st.n AS n, st.avgdl AS avgdl
FROM t, unnest(tok) AS u(term), st GROUP BY u.term, st.n, st.avgdl""")
def q_doc_freq(spark, sf_dir):
    m = _m(spark, sf_dir)
    t = materialise(m.select("platform", "id", tokenise(combined_text("title", "text")).alias("tok")), "df-tokens")
    tf = term_frequencies(t, ("platform", "id"), tokens="tok")
    st = corpus_stats(t, tokens="tok")
    n = st.select(F.col("n").cast("bigint")).scalar()
    avgdl = st.select(F.round(F.col("avgdl"), 6)).scalar()
    return tf.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df")).select(
        "term", "df", n.alias("n"), avgdl.alias("avgdl"))


# --- R2 TF-IDF vectors ------------------------------------------------------------
@query("tfidf_vectors", f"""{M},
t AS (SELECT platform, id, {duck_tokenise(_COMB)} AS tok FROM mentions),
st AS (SELECT count(*)::DOUBLE AS n FROM t),
tf AS (SELECT platform, id, u.term AS term, count(*)::DOUBLE AS tf, max(len(tok))::DOUBLE AS dl
       FROM t, unnest(tok) AS u(term) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)
SELECT platform, id, term, round(tf / greatest(dl, 1) * ln((st.n + 1) / (df + 1)), 6) AS weight
FROM tf JOIN df USING (term), st""")
def q_tfidf_vectors(spark, sf_dir):
    m = _m(spark, sf_dir)
    v = tfidf_vectors(m, ("platform", "id"), combined_text("title", "text"))
    return v.select("platform", "id", "term", F.round("weight", 6).alias("weight"))


# --- near duplicates (J6 / R3 / D3 / A9) -------------------------------------------------
from ..config import COSINE_EPSILON, NEAR_DUP_THRESHOLD  # noqa: E402
from ..functions.text import fuzzy_contains  # noqa: E402
from ..operators.cooccurrence import word_cloud  # noqa: E402
from ..operators.neardup import near_duplicate_flags, near_duplicate_pairs  # noqa: E402



def _vectors_sql(collapse: bool) -> str:
    """DuckDB TF-IDF vectors; with `collapse`, only first records of exact-copy groups."""
    head = f"""dt AS (SELECT seq AS node, platform AS part, {duck_tokenise(_COMB)} AS tok FROM mentions),
nn AS (SELECT count(*)::DOUBLE AS n FROM dt),
grp AS (SELECT node, part, min(node) OVER (PARTITION BY part, sig) AS rep,
               count(*) OVER (PARTITION BY part, sig) AS cnt
        FROM (SELECT node, part, sha256(array_to_string(list_sort(tok), ' ')) AS sig FROM dt)),
"""
    if collapse:
        src = "SELECT dt.node, dt.part, dt.tok, g.cnt FROM dt JOIN grp g ON g.node = dt.node WHERE g.node = g.rep"
    else:
        src = "SELECT dt.node, dt.part, dt.tok, 1 AS cnt FROM dt"
    return head + f"""vs AS ({src}),
tf AS (SELECT node, part, term, count(*)::DOUBLE AS tf, max(dl)::DOUBLE AS dl, max(cnt) AS cnt
       FROM (SELECT node, part, cnt, len(tok) AS dl, unnest(tok) AS term FROM vs) GROUP BY node, part, term),
df AS (SELECT term, sum(cnt)::DOUBLE AS df FROM tf GROUP BY term),
v AS (SELECT tf.node, tf.part, tf.term, tf.tf / greatest(tf.dl, 1) * ln((nn.n + 1) / (df.df + 1)) AS w
      FROM tf JOIN df USING (term), nn),
nrm AS (SELECT node, sqrt(sum(w * w)) AS norm FROM v GROUP BY node),
pr AS (SELECT a.part, a.node AS a, b.node AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b
       ON a.part = b.part AND a.term = b.term AND a.node < b.node GROUP BY a.part, a.node, b.node),
sim AS (SELECT pr.part, pr.a, pr.b, pr.dot / (na.norm * nb.norm + {COSINE_EPSILON}) AS cosine
        FROM pr JOIN nrm na ON na.node = pr.a JOIN nrm nb ON nb.node = pr.b
        WHERE pr.dot / (na.norm * nb.norm + {COSINE_EPSILON}) >= {{t}})"""


def _pairs_sql(t: float) -> str:
    return f"""{M},
{_vectors_sql(True).replace('{t}', str(t))}
SELECT ma.platform AS a_platform, ma.id AS a_id, mb.platform AS b_platform, mb.id AS b_id,
       round(sim.cosine, 6) AS cosine
FROM sim JOIN mentions ma ON ma.seq = sim.a JOIN mentions mb ON mb.seq = sim.b"""


def _flags_body(t: float) -> str:
    """Reference semantics verbatim: all pairs (copies included), sequential greedy scan."""
    return f"""{_vectors_sql(False).replace('{t}', str(t))},
gn AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT a AS node FROM sim UNION SELECT b FROM sim)),
nb AS (SELECT gn.node, gn.k, coalesce(list(s.a) FILTER (WHERE s.a IS NOT NULL), []) AS earlier
       FROM gn LEFT JOIN sim s ON s.b = gn.node GROUP BY gn.node, gn.k),
r(k, kept) AS (SELECT 0, []::BIGINT[]
               UNION ALL
               SELECT r.k + 1, CASE WHEN list_has_any(r.kept, nb.earlier) THEN r.kept
                                    ELSE list_append(r.kept, nb.node) END
               FROM r JOIN nb ON nb.k = r.k + 1),
fin AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1),
dups AS (SELECT gn.node FROM gn, fin WHERE NOT list_contains(fin.kept, gn.node))"""


def _flags_sql(t: float, m: str = M) -> str:
    return m.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
{_flags_body(t)}
SELECT m.platform, m.id, m.seq IN (SELECT node FROM dups) AS is_near_duplicate FROM mentions m"""


@query("near_duplicate_pairs", _pairs_sql(NEAR_DUP_THRESHOLD))
def q_near_duplicate_pairs(spark, sf_dir):
    m = _m(spark, sf_dir)
    p = near_duplicate_pairs(m, ("platform", "id"), "seq", "platform", combined_text("title", "text"),
                             NEAR_DUP_THRESHOLD)
    return p.select("a_platform", "a_id", "b_platform", "b_id", F.round("cosine", 6).alias("cosine"))


@query("near_duplicate_flags", _flags_sql(NEAR_DUP_THRESHOLD))
def q_near_duplicate_flags(spark, sf_dir):
    m = _m(spark, sf_dir)
    return near_duplicate_flags(m, ("platform", "id"), "seq", "platform", combined_text("title", "text"),
                                NEAR_DUP_THRESHOLD)


@query("near_duplicate_flags_t05", _flags_sql(0.5))
def q_near_duplicate_flags_t05(spark, sf_dir):
    m = _m(spark, sf_dir)
    return near_duplicate_flags(m, ("platform", "id"), "seq", "platform", combined_text("title", "text"),
                                0.5)


@query("near_dup_count", M.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
{_flags_body(NEAR_DUP_THRESHOLD)}
SELECT m.platform, count(*) FILTER (WHERE m.seq IN (SELECT node FROM dups))::BIGINT AS near_duplicates,
       count(*)::BIGINT AS total FROM mentions m GROUP BY m.platform""")
def q_near_dup_count(spark, sf_dir):
    m = _m(spark, sf_dir)
    f = near_duplicate_flags(m, ("platform", "id"), "seq", "platform", combined_text("title", "text"),
                             NEAR_DUP_THRESHOLD)
    return f.groupBy("platform").agg(F.count_if("is_near_duplicate").cast("bigint").alias("near_duplicates"),
                                     F.count(F.lit(1)).cast("bigint").alias("total"))


# --- fuzzy brand match (X9 / F6 / R5 / J8) ---------------------------------------------
def _ASCII1(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', chr(1), 'g')"


def _fuzzy_sql_expr(text_expr: str, variants) -> str:
    # DuckDB's levenshtein counts bytes; variants are ASCII, so every non-ASCII
    # character is mapped to one placeholder byte that equals no variant character.
    conds = " OR ".join(f"(abs(length(w) - {len(v)}) <= 1 AND levenshtein({_ASCII1('w')}, '{v}') <= 1)"
                        for v in variants)
    return (f"len(list_filter(regexp_extract_all(lower(coalesce({text_expr}, '')), '[\\p{{L}}\\p{{N}}_]{{4,}}'), "
            f"lambda w: {conds})) > 0")


@query("fuzzy_brand_match", f"""{M}
SELECT platform, id, {_fuzzy_sql_expr(_COMB, P.variants)} AS fuzzy_brand_match FROM mentions""")
def q_fuzzy_brand_match(spark, sf_dir):
    m = _m(spark, sf_dir)
    return m.select("platform", "id", fuzzy_contains(combined_text("title", "text"), P.variants)
                    .alias("fuzzy_brand_match"))


# --- X8 Levenshtein: words within 2 edits of a variant --------------------------------
@query("levenshtein_words", f"""{M},
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce({_COMB}, '')), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS word FROM mentions),
v(variant) AS (VALUES {", ".join(f"('{x}')" for x in P.variants)})
SELECT word, variant, levenshtein({_ASCII1('word')}, variant)::INTEGER AS distance FROM w, v
WHERE abs(length(word) - length(variant)) <= 2 AND levenshtein({_ASCII1('word')}, variant) <= 2""")
def q_levenshtein_words(spark, sf_dir):
    from ..functions.text import word_runs
    m = _m(spark, sf_dir)
    words = m.select(F.explode(word_runs(combined_text("title", "text"))).alias("word")).distinct()
    out = None
    for v in P.variants:  # one narrow projection per variant (variants are a short list)
        d = F.levenshtein(F.col("word"), F.lit(v), 2)
        x = words.where(F.abs(F.length("word") - len(v)) <= 2).select(
            "word", F.lit(v).alias("variant"), d.cast("int").alias("distance")).where(F.col("distance") >= 0)
        out = x if out is None else out.unionByName(x)
    return out


# --- A8 / R7 word cloud ------------------------------------------------------------------
@query("word_cloud", f"""{M},
d AS (SELECT seq, lower(coalesce({_COMB}, '')) AS t FROM mentions),
tk AS (SELECT seq, {duck_tokenise('t')} AS tok FROM d WHERE position('{P.brand}' IN t) > 0),
ex AS (SELECT seq, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM tk),
ag AS (SELECT term, count(*) AS cnt, min((seq, pos)) AS fs FROM ex
       WHERE length(term) > 3 AND term <> '{P.brand}' GROUP BY term)
SELECT word, count, rnk FROM (
  SELECT term AS word, cnt::BIGINT AS count, row_number() OVER (ORDER BY cnt DESC, fs) AS rnk FROM ag)
WHERE rnk <= 50""")
def q_word_cloud(spark, sf_dir):
    m = _m(spark, sf_dir)
    return word_cloud(m, P.brand, combined_text("title", "text"), "seq")


# --- R6 search enrichment (BM25 + near-dup + fuzzy, one row per mention) ---------------
def _search_enrich_sql(m: str = M) -> str:
    b = _bm25_sql(P.reference_query, m) + """
SELECT d.platform, d.id, round(coalesce(sc.s, 0.0), 4) AS bm25_score
FROM docs d LEFT JOIN sc ON sc.platform = d.platform AND sc.id = d.id"""
    f = _flags_sql(NEAR_DUP_THRESHOLD, m)
    z = f"""{m}
SELECT platform, id, {_fuzzy_sql_expr(_COMB, P.variants)} AS fuzzy_brand_match FROM mentions"""
    return f"""SELECT b.platform, b.id, b.bm25_score, f.is_near_duplicate, z.fuzzy_brand_match
FROM ({b}) b JOIN ({f}) f USING (platform, id) JOIN ({z}) z USING (platform, id)"""


@query("search_enrich", _search_enrich_sql())
def q_search_enrich(spark, sf_dir):
    from ..operators.search import search_enrich
    m = _m(spark, sf_dir)
    return search_enrich(m, P, text=combined_text("title", "text")).select(
        "platform", "id", "bm25_score", "is_near_duplicate", "fuzzy_brand_match")
