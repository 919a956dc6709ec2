"""From raw documents to token ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next stage's `docs`.
All stages but the last return the columns of documents, whatever columns the input has.
Columns other than doc_id and text (and lang, from which languages are learned) are carried
along and never looked at, so names of their own do not clash with those of an operator.

Defined cases: see the operators. A null or empty text is rejected by the first stage; rows
with a null id go through all stages, and of equal or similar texts a row with an id stays in
their place; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brandlens.llm import byte_bpe, contamination, exact_dedup, jaccard_join, language
from brandlens.llm.common import scratch_dir, table


#: Documents are near copies from this Jaccard similarity (hundredths) of their word shingles on.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return language.with_language(docs, language.fit(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.keep_rows(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents, the one with the smallest id."""
    return jaccard_join.representatives(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and digests of the ids and their decoded bytes."""
    return byte_bpe.digests(docs)


STAGES = [
    ("language", known_language),
    ("exact dedup", distinct_texts),
    ("similar documents", distinct_content),
    ("decontamination", without_benchmark),
    ("token ids", token_ids),
]

#: No SQL: the first stage is a learned model, the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark, 'pipeline')}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
