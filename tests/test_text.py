from pyspark.sql import functions as F

from brandlens.config import BrandProfile
from brandlens.functions.text import (combined_text, fuzzy_contains, sentiment_text, tokenise,
                                      tokenise_py)
from brandlens.operators.gates import relevance_gate
from brandlens.operators.sentiment import sentiment_label


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_tokenise_golden(spark):
    stop = ("it", "a")
    got = _one(spark, tokenise(F.col("t"), stop), [("Hello.World it's  a_b",), ("b cc",)], "t string")
    assert got == [["hello", "world"], ["cc"]]
    assert tokenise_py("Hello.World it's  a_b", stop) == ["hello", "world"]


def test_tokenise_matches_python_whitespace(spark):
    texts = ["x yy\tzz　ww", "  lead trail  ", "a\u0085bb cc", "", None]
    got = _one(spark, tokenise(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [tokenise_py(t) for t in texts]


def test_combined_text(spark):
    rows = [("", "x"), (None, "x"), ("t", "x"), (None, None)]
    got = _one(spark, combined_text("title", "text"), rows, "title string, text string")
    assert got == ["x", "x", "t x", ""]


def test_sentiment_text(spark):
    rows = [("reddit", " T ", "body\n"), ("twitter", "T", "body"), ("reddit", None, "b")]
    got = _one(spark, sentiment_text(), rows, "platform string, title string, text string")
    assert got == ["T  body", "body", "b"]


def test_gate_golden(spark):
    p = BrandProfile(brand="acme", blocklist=("motor",), keywords=("app",))
    rows = [("Acme app",), ("acme",), ("acme app motorbike",), ("ACME happy",), ("app",)]
    got = _one(spark, relevance_gate(p, F.lit(None).cast("string"), "t"), rows, "t string")
    assert got == [True, False, False, True, False]


def test_fuzzy_golden(spark):
    rows = [("acmes",), ("acme",), ("acm",), ("accmexy",), ("an ACMEX!",)]
    got = _one(spark, fuzzy_contains(F.col("t"), ["acmex"]), rows, "t string")
    assert got == [True, True, False, False, True]


def test_sentiment_label_cutoffs(spark):
    rows = [(0.05,), (-0.05,), (0.0499,), (-0.0499,)]
    got = _one(spark, sentiment_label(F.col("c")), rows, "c double")
    assert got == ["positive", "negative", "neutral", "neutral"]


def test_gate_whole_word(spark):
    p = BrandProfile(brand="acme", blocklist=("motor",), keywords=("app",))
    rows = [("Acme app",), ("ACME happy",), ("acme app motorbike",), ("acmes app",)]
    got = _one(spark, relevance_gate(p, F.lit(None).cast("string"), "t", whole_word=True), rows, "t string")
    assert got == [True, False, True, False]
