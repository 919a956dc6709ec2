"""Term counts inside a row, and rows that share their keys."""

from collections import Counter

from brandlens.functions.text import tokenise_py
from brandlens.operators.block_index import build_index
from brandlens.operators.ranking import term_frequencies, with_term_counts

SCHEMA = "platform string, id string, seq long, text string"
ROWS = [("p", "a", 1, "red red blue"), ("p", "b", 2, ""), ("p", "c", 3, None), ("p", None, 4, "moss moss red"),
        ("q", "a", 5, "blue"), ("p", "d", 6, "red moss"), ("p", "d", 6, "red moss"), ("p", None, 4, "moss moss red")]


def test_counts_are_made_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, tokenise_py(r[3])) for i, r in enumerate(ROWS)], "id long, _tok array<string>").write.parquet(path)
    counts = with_term_counts(spark.read.parquet(path))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and plan.count("sort_array") == 1
    got = {(r.id, r.term): r.tf for r in counts.collect()}
    assert got == {(i, t): n for i, r in enumerate(ROWS) for t, n in Counter(tokenise_py(r[3])).items()}


def test_rows_with_equal_keys_are_one_document(spark):
    got = [tuple(r) for r in term_frequencies(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    want = Counter()
    for platform, i, _, text in ROWS:
        for t in tokenise_py(text):
            want[platform, i, t] += 1
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    assert {g[:2]: g[4] for g in got} == {("p", "a"): 3, ("q", "a"): 1, ("p", None): 3, ("p", "d"): 2}


def test_postings_of_the_index_count_inside_rows(spark):
    index = build_index(spark.createDataFrame(ROWS[:4], SCHEMA), ["platform", "id"], ["seq"])
    assert {r.term: r.df for r in index.terms.collect()} == {"red": 2, "blue": 1, "moss": 1}
    assert index.n == 4
