"""Word cloud: tokens that co-occur with the brand.

Over documents whose lower-cased text contains the brand (substring), count every token
occurrence longer than `min_len - 1` characters other than the brand itself. Ties in
the count keep first-seen order (document order, then token position).

Plan: explode tokens with positions, aggregate per term with `count` and
`min(struct(order, pos))` — both partial aggregates, so a very common term is combined
inside each task before the shuffle — then TakeOrderedAndProject for the top N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STOP_WORDS, WORD_CLOUD_MIN_LEN, WORD_CLOUD_TOP_N
from ..functions.text import tokenise


def cooccurring_terms(docs: DataFrame, brand: str, text: Column | str, order: str = "seq",
                      min_len: int = WORD_CLOUD_MIN_LEN, stop_words=STOP_WORDS) -> DataFrame:
    """term, count, first_seen (struct of order, pos) over all matching documents."""
    text_col = F.col(text) if isinstance(text, str) else text
    b = brand.lower()
    d = docs.select(F.col(order).alias("_o"), F.lower(F.coalesce(text_col, F.lit(""))).alias("_t")) \
        .where(F.instr(F.col("_t"), b) > 0)
    toks = F.filter(tokenise(F.col("_t"), stop_words), lambda x: (x != F.lit(b)) & (F.length(x) >= min_len))
    ex = d.select("_o", F.posexplode(toks).alias("pos", "term"))
    return ex.groupBy("term").agg(F.count(F.lit(1)).alias("count"),
                                  F.min(F.struct(F.col("_o"), F.col("pos"))).alias("first_seen"))


def word_cloud(docs: DataFrame, brand: str, text: Column | str, order: str = "seq",
               top_n: int = WORD_CLOUD_TOP_N, min_len: int = WORD_CLOUD_MIN_LEN,
               stop_words=STOP_WORDS) -> DataFrame:
    """word, count, rnk for the top N terms."""
    t = cooccurring_terms(docs, brand, text, order, min_len, stop_words)
    o = [F.col("count").desc(), F.col("first_seen").asc()]
    top = t.orderBy(*o).limit(top_n)
    return top.select(F.col("term").alias("word"), F.col("count").cast("bigint").alias("count"),
                      F.row_number().over(Window.orderBy(*o)).cast("bigint").alias("rnk"))
