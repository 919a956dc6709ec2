"""Search that tolerates one wrong, missing or additional character, over a vocabulary index.

Method: a deletion neighbourhood. Two words within one edit share the word itself or a form with
one character left out, so the vocabulary is indexed by these forms (one row per word and
character), query words are looked up by equi-join, and the few candidates are verified with the
edit distance. The table of documents is only met through the words that were found.

Words of more than `LONGEST` characters would have long lists of long forms. One edit leaves
either the first or the last characters of such a word as they are, so these two are its keys.
Words near the bound have both kinds of keys, hence every pair within one edit shares a key.

Plan: the vocabulary is a partial aggregate; a frequent word is one row of it. A document's words
are made distinct before they are joined, so repeated words cost one row.

Null and blank texts and query words have no words and no hits; repeated query words are one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words

#: Longest word that is indexed by its deletions, and characters of a longer word's keys.
LONGEST = 40
END = LONGEST // 2 - 1


def keys_of(word: Column) -> Column:
    """Array of the keys that words within one edit have in common, one at least."""
    size = F.char_length(word)
    less = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(LONGEST))), lambda i: F.concat(
        F.lit("d"), F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    short = F.when(size <= LONGEST, F.array_union(F.array(F.concat(F.lit("d"), word)), less)).otherwise(F.array())
    ends = F.when(size >= LONGEST - 1, F.array(F.concat(F.lit("f"), F.substring(word, 1, END)),
                                               F.concat(F.lit("l"), F.substring(word, -END, END)))).otherwise(F.array())
    return F.concat(short, ends)


def distinct_words(text: Column) -> Column:
    """Array of the distinct words of a text."""
    return F.array_distinct(split_words(text))


def document_words(docs: DataFrame, text: Column | str, keys: Sequence[str]) -> DataFrame:
    """keys + word, one row for every distinct word of a document. `text` is a text, or the name
    of a column of `distinct_words`, which is best written first: words are read twice."""
    words = F.col(text) if isinstance(text, str) else distinct_words(text)
    return docs.select(*keys, F.explode(words).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n_docs."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def near_words(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """query, word, distance (0 or 1), n_docs for the words of `vocab` within one edit of `query`."""
    asked = (queries.select(F.lower("query").alias("query")).filter("query <> ''").distinct()
             .select("query", F.explode(keys_of(F.col("query"))).alias("form")))
    index = vocab.select("word", "n_docs", F.explode(keys_of(F.col("word"))).alias("form"))
    return (asked.join(index, "form").withColumn("distance", F.levenshtein("query", "word", 1))
            .filter("distance >= 0").groupBy("query", "word")
            .agg(F.first("distance").alias("distance"), F.first("n_docs").alias("n_docs")))


def spelling_hits(words: DataFrame, near: DataFrame, keys: Sequence[str]) -> DataFrame:
    """query + keys + distance: the documents that hold a word within one edit of a query, with
    the smallest distance."""
    found = words.join(near.select("query", "word", "distance"), "word")
    return found.groupBy("query", *keys).agg(F.min("distance").alias("distance"))
