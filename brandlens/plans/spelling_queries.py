"""Registered queries of the spelling-tolerant search, with their DuckDB oracle. Query words are
the plain words of four and more characters in the benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import combined_text, split_words
from ..operators import spelling
from ..session import materialise, prepare
from ..sources.driver import duck_split_words, mentions, mentions_sql
from .registry import query

KEYS = ("platform", "id")
_ORACLE = f"""WITH mentions AS ({mentions_sql()}),
w AS (SELECT DISTINCT platform, id, unnest({duck_split_words("concat_ws(' ', nullif(title, ''), nullif(text, ''))")}) AS word
      FROM mentions),
v AS (SELECT word, regexp_replace(word, '[^\\x00-\\x7F]', chr(1), 'g') AS plain, count(*) AS n_docs FROM w GROUP BY word),
q AS (SELECT DISTINCT word AS query FROM (SELECT unnest({duck_split_words('text')}) AS word FROM benchmark)
      WHERE regexp_full_match(word, '[a-z0-9]{{4,}}')),
near AS (SELECT query, word, levenshtein(plain, query)::INTEGER AS distance, n_docs FROM q, v
         WHERE abs(length(plain) - length(query)) <= 1 AND levenshtein(plain, query) <= 1),
hits AS (SELECT query, platform, id, min(distance) AS distance FROM near JOIN w USING (word) GROUP BY ALL)"""


def _words(spark, sf_dir):
    prepare(spark)
    # split once; the vocabulary and the hits both read the written words
    m = materialise(mentions(spark, sf_dir).select(
        *KEYS, spelling.distinct_words(combined_text("title", "text")).alias("words")), "spelling-words")
    docs = spelling.document_words(m, "words", KEYS)
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    asked = texts.select(F.explode(split_words("text")).alias("query")).filter(F.col("query").rlike("^[a-z0-9]{4,}$"))
    return docs, materialise(spelling.near_words(asked, spelling.vocabulary(docs)), "spelling-near")


@query("spelling_words", f"{_ORACLE} SELECT query, word, distance, n_docs FROM near")
def q_spelling_words(spark, sf_dir):
    return _words(spark, sf_dir)[1]


@query("spelling_search", f"""{_ORACLE}
SELECT query, count(*) AS n_docs, count(*) FILTER (WHERE distance = 0) AS n_exact, min(id) AS first_id
FROM hits GROUP BY query""")
def q_spelling_search(spark, sf_dir):
    docs, near = _words(spark, sf_dir)
    return (spelling.spelling_hits(docs, near, KEYS).groupBy("query")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("distance") == 0).alias("n_exact"),
                 F.min("id").alias("first_id")))
