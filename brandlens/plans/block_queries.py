"""Registered queries of the index with block maxima, with their DuckDB oracle. Queries are the
benchmark texts, searched in all mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1
from ..functions.text import combined_text
from ..operators.block_index import BLOCK, build_index, top_k
from ..session import prepare
from ..sources.driver import duck_tokenise, mentions, mentions_sql
from .registry import query

_ORACLE = f"""WITH mentions AS ({mentions_sql()}),
docs AS (SELECT platform, id, row_number() OVER (ORDER BY seq) AS doc,
                {duck_tokenise("concat_ws(' ', nullif(title, ''), nullif(text, ''))")} AS tok FROM mentions),
q AS (SELECT query_id, u.term AS term, count(*) AS times
      FROM (SELECT item_id AS query_id, {duck_tokenise('text')} AS tok FROM benchmark), unnest(tok) AS u(term) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tok))::DOUBLE AS avgdl FROM docs),
tf AS (SELECT platform, id, doc, len(tok) AS dl, u.term AS term, count(*)::DOUBLE AS tf
       FROM docs, unnest(tok) AS u(term) WHERE u.term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, platform, id, doc,
              round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * {BM25_K1 + 1.0})
                        / (tf + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * dl / avgdl))), 4) AS bm25_score
       FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _search(spark, sf_dir):
    prepare(spark)
    index = build_index(mentions(spark, sf_dir), ["platform", "id"], ["seq"], combined_text("title", "text"))
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return top_k(index, texts.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("block_top10", f"""{_ORACLE}
SELECT query_id, platform, id, bm25_score, rnk
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc) AS rnk FROM sc)
WHERE rnk <= 10""")
def q_block_top10(spark, sf_dir):
    return _search(spark, sf_dir)[0].withColumnRenamed("score", "bm25_score")


_SHARE = f"tf * {BM25_K1 + 1.0} / (tf + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * dl / avgdl))"


@query("block_top10_read", f"""{_ORACLE},
bl AS (SELECT term, (doc - 1) // {BLOCK} AS block, max({_SHARE}) AS most FROM tf, st GROUP BY ALL),
bo AS (SELECT query_id, block, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * most), 9) AS bound
       FROM bl JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL),
ld AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, block) AS place FROM bo),
fd AS (SELECT sc.query_id, bm25_score AS reached,
              row_number() OVER (PARTITION BY sc.query_id ORDER BY bm25_score DESC, doc) AS r
       FROM sc JOIN ld ON ld.query_id = sc.query_id AND ld.block = (doc - 1) // {BLOCK} AND place <= 10)
SELECT query_id, count(*) AS n_blocks,
       count(*) FILTER (WHERE place <= 10 OR reached IS NULL OR bound >= reached - 0.0001) AS n_scored
FROM ld LEFT JOIN (SELECT query_id, reached FROM fd WHERE r = 10) USING (query_id) GROUP BY query_id""")
def q_block_top10_read(spark, sf_dir):
    """Blocks that hold a term of each query, and those of them that were scored."""
    return _search(spark, sf_dir)[1]
