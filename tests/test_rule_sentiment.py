import math
import re

import pytest

from brandlens.operators.rule_sentiment import SentimentRules, rule_sentiment

RULES = SentimentRules(
    lexicon={"good": 1.9, "great": 3.1, "bad": -2.5, "hit": -0.5, "big hit": 2.0, "big hit song": 2.6},
    negators=("not",), boosters={"very": 0.293, "kind of": -0.293}, contrast=("but",))


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


GOLDEN = {
    "it is good": compound(1.9),
    "it is very good": compound(1.9 + 0.293),
    "very x good": compound(1.9 + 0.293 * 0.95),
    "very x y bad": compound(-2.5 - 0.293 * 0.9),
    "very x y z bad": compound(-2.5),
    "kind of good": compound(1.9 - 0.293),
    "not x y good": compound(1.9 * -0.74),
    "not x y z good": compound(1.9),
    "it is GOOD": compound(1.9 + 0.733),
    "IT IS GOOD": compound(1.9),
    "it is VERY bad": compound(-2.5 - 0.293 - 0.733),
    "good!!": compound(1.9 + 2 * 0.292),
    "bad!!!!!!!": compound(-2.5 - 4 * 0.292),
    "good?": compound(1.9),
    "good???": compound(1.9 + 3 * 0.18),
    "good????": compound(1.9 + 0.96),
    "good but bad": compound(1.9 * 0.5 - 2.5 * 1.5),
    "a big hit": compound(2.0),
    "a big hit song": compound(2.6),
    "a Big, HIT": compound(2.0),
    "big big hit": compound(2.0),
    "big hit big hit": compound(4.0),
    "a bighit hit": compound(-0.5),
    "plain words": 0.0, "": 0.0, " \n\t": 0.0, "?!": 0.0,
}


def test_golden_sentences(spark):
    rows = spark.createDataFrame(list(enumerate(GOLDEN)), "id long, text string")
    found = {r.id: r.compound for r in rule_sentiment(rows, RULES, keep=("id",)).collect()}
    assert found == {i: pytest.approx(v, abs=1e-4) for i, v in enumerate(GOLDEN.values())}


def test_shares_and_labels(spark):
    rows = spark.createDataFrame([(1, "good x bad!"), (2, None), (3, "?!"), (4, "great y")], "id long, text string")
    found = {r.id: r for r in rule_sentiment(rows, RULES, keep=("id",)).collect()}
    total = 2.9 + 3.5 + 0.292 + 1
    assert (found[1].pos, found[1].neu, found[1].neg) == (
        round(2.9 / total, 4), round(1 / total, 4), round(3.792 / total, 4))
    assert tuple(found[2])[1:] == ("neutral", 0.0, 0.0, 1.0, 0.0)
    assert tuple(found[3])[1:] == ("neutral", 0.0, 0.0, 0.0, 0.0)
    assert found[4].label == "positive" and found[1].label == "negative"


def test_no_shuffle_no_join_and_odd_names(spark):
    rows = spark.createDataFrame([(1, "good", "x")] * 2, "id long, _text string, label2 string")
    scored = rule_sentiment(rows, RULES, "_text", keep=("id", "_text"))
    assert scored.count() == 2
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Window|Generate|Python", plan)


def test_without_phrases_or_boosters(spark):
    rules = SentimentRules({"good": 1.0}, (), {}, ())
    rows = spark.createDataFrame([(1, "very good but")], "id long, text string")
    assert rule_sentiment(rows, rules, keep=("id",)).first().compound == compound(1.0)


def test_a_text_is_cut_into_words_once(spark):
    """Phrases are split and found in one written-out text, not in two copies of the steps before."""
    rows = spark.createDataFrame([(1, "kind of good, not a BIG hit song\u00a0but bad")], "id long, text string")
    scored = rule_sentiment(rows, RULES, keep=("id",))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("lower(") == 1
    assert scored.first().compound == compound(((1.9 - 0.293) * 0.5) + (2.6 * -0.74 - 0) * 0.5 - 2.5 * 1.5)
