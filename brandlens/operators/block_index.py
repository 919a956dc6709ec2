"""Inverted index with block maxima: BM25 top-k for a table of queries that skips blocks.

Documents are numbered in a total order and cut into blocks of `BLOCK` numbers. A term has one
row per block with its postings there (document, occurrences, length; at most `BLOCK`) and the
largest BM25 share of any of them, so a term that a third of all documents hold is many small
rows. Blocks of all terms are cut alike: the sum of a query's block maxima bounds every score in
the block, and a block's postings give whole scores.

A search reads the maxima alone first. The k blocks with the highest bounds, each with a hit, are
scored and give each query a score that k documents reach; of the other blocks only those whose bound reaches
it are scored. Results equal full scoring. All steps are equi-joins and aggregates; the number of
bounds is at most queries times blocks that hold one of their terms.

Defined cases: documents without a token are counted but never found; a query finds only documents
that hold one of its terms (fewer than k if there are no more); a repeated query term counts once
per repetition; repeated query ids are one query of all their terms; null and empty queries and
an empty corpus give no rows; ties in the rounded score go to the earlier document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, STOP_WORDS
from ..functions.text import tokenise
from ..session import materialise, release
from .ranking import with_term_counts
from .reports import global_rank

BLOCK = 128
#: Places of a score. Of two scores equal after rounding one may be less by the last place, so
#: bounds that much below the reached score still count.
PLACES = 4


@dataclass
class BlockIndex:
    """`packed` (term, block, max_share, n, _postings), `postings` (they as documents and shares), `terms`
    (term, df), `numbers` (keys, doc) and the number of documents."""

    packed: DataFrame
    postings: Column
    terms: DataFrame
    numbers: DataFrame
    n: int

    @property
    def blocks(self) -> DataFrame:
        """term, block, max_share, postings (doc, share)."""
        return self.packed.select("term", "block", "max_share", self.postings.alias("postings"))


def build_index(docs: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column | str = "text",
                stop_words: Sequence[str] = STOP_WORDS, k1: float = BM25_K1, b: float = BM25_B,
                block: int = BLOCK) -> BlockIndex:
    """The index of `docs`, written under the shared folder. The columns `order` must give a
    total order; the numbers of documents follow it."""
    text_col = F.col(text) if isinstance(text, str) else text
    columns = list(dict.fromkeys([*keys, *order]))
    tokens = docs.select(*columns, F.sort_array(tokenise(text_col, stop_words)).alias("_tok"))
    # tokens hold no white space; as one sorted text they take half the room of an array
    tokens = tokens.select(*columns, F.size("_tok").alias("dl"), F.array_join("_tok", " ").alias("_words"))
    ranked = global_rank(tokens, [F.col(c) for c in order], "doc")
    numbers = materialise(ranked.select(*keys, "doc", "dl"), "index-numbers")
    size = numbers.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()

    def share(tf: Column, dl: Column) -> Column:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(size["avgdl"])))

    # the documents of a block meet before their terms are counted (each inside its own row), so
    # tokens are moved, once, and no postings; a posting is written as three small numbers
    place = F.floor((F.col("doc") - 1) / block)
    met = ranked.where("dl > 0").select(place.alias("block"), "doc", "dl", "_words").repartition("block")
    postings = with_term_counts(met.select("block", "doc", "dl", F.split("_words", " ").alias("_tok")))
    blocks = (postings.withColumn("at", (F.col("doc") - 1 - F.col("block") * block).cast("int")).groupBy("term", "block")
              .agg(F.max(share(F.col("tf"), F.col("dl"))).alias("max_share"), F.count(F.lit(1)).alias("n"),
                   F.sort_array(F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf"), "dl"))).alias("_postings")))
    blocks = materialise(blocks, "index-blocks")
    release(ranked)
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    found = F.transform("_postings", lambda p: F.struct(
        (F.col("block") * block + p["at"] + 1).alias("doc"), share(p["tf"], p["dl"]).alias("share")))
    return BlockIndex(blocks, found, materialise(terms, "index-terms"), numbers.select(*keys, "doc"), size["n"])


def query_terms(index: BlockIndex, queries: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """query_id, term, weight (repetitions times inverse document frequency) of `queries`
    (query_id, query)."""
    asked = (queries.select("query_id", F.explode(tokenise(F.col("query"), stop_words)).alias("term"))
             .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    idf = F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))


def _scores(some: DataFrame, terms: DataFrame, held: DataFrame, index: BlockIndex) -> DataFrame:
    """query_id, doc, score of every posting's document in the blocks `some` (query_id, block); `held`
    are the index's packed blocks of the queries' terms."""
    wanted = some.select("query_id", "block").join(terms, "query_id")
    hits = wanted.join(held.select("term", "block", "_postings"), ["term", "block"])
    return (hits.select("query_id", "weight", F.inline(index.postings)).groupBy("query_id", "doc")
            .agg(F.round(F.sum(F.col("weight") * F.col("share")), PLACES).alias("score")))


def _best(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc"))
    return scores.withColumn("rnk", place).filter(F.col("rnk") <= k)


def top_k(index: BlockIndex, queries: DataFrame, k: int = 10,
          stop_words: Sequence[str] = STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each query (query_id, keys, score, rnk) and what was read for it
    (query_id, n_blocks with a term of the query, n_scored of them)."""
    terms = materialise(query_terms(index, queries, stop_words), "query-terms")
    # what the queries' terms have, written once: the joins below move nothing of other terms
    held = materialise(index.packed.join(terms.select("term").distinct(), "term", "left_semi"), "query-blocks")
    bounds = (terms.join(held.select("term", "block", "max_share"), "term").groupBy("query_id", "block")
              .agg(F.round(F.sum(F.col("weight") * F.col("max_share")), 9).alias("bound")))
    bounds = materialise(bounds, "block-bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    leading = materialise(bounds.withColumn("_place", place).filter(F.col("_place") <= k), "leading-blocks")
    found = materialise(_best(_scores(leading, terms, held, index), k), "leading-scores")
    reached = found.filter(F.col("rnk") == k).select("query_id", F.col("score").alias("_reached"))
    others = (bounds.join(leading.select("query_id", "block"), ["query_id", "block"], "left_anti")
              .join(reached, "query_id", "left")
              .filter(F.col("_reached").isNull() | (F.col("bound") >= F.col("_reached") - 10.0 ** -PLACES)))
    others = materialise(others.select("query_id", "block"), "other-blocks")
    scores = found.select("query_id", "doc", "score").unionByName(_scores(others, terms, held, index))
    best = _best(scores, k).join(index.numbers, "doc").drop("doc").withColumn("rnk", F.col("rnk").cast("long"))
    scored = (leading.select("query_id").unionByName(others.select("query_id"))
              .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored")))
    read = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks")).join(scored, "query_id")
    return best, read
