import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from brandlens.llm import exact_dedup as X


def fold(text):
    return text.translate(str.maketrans(X.UPPER, X.UPPER.lower()))


def groups(texts):
    found = defaultdict(list)
    for i, t in texts:
        found[fold(t)].append(i)
    return found


def check(rows, texts):
    found = groups(texts)
    assert len(rows) == len(texts)
    for t, ids in found.items():
        own = [r for r in rows if r.digest == hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and sum(r.kept for r in own) == 1
        assert {r.keep_id for r in own} == {best} and {r.group_size for r in own} == {len(ids)}
        assert next(r.doc_id for r in own if r.kept) == best


def test_odd_rows(odd_docs, texts):
    check(X.dedup(odd_docs).collect(), texts)


def test_empty_table(no_docs):
    assert X.dedup(no_docs).collect() == []


def test_state_lasts_over_runs_and_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "doc_id long, text string")
    X.dedup(first.repartition(3), store, files_per_batch=1)
    second = spark.createDataFrame([(20, "T1"), (21, "new")], "doc_id long, text string")
    rows = {r.doc_id: r for r in X.dedup(second, store, files_per_batch=1).collect()}
    assert rows[1].keep_id == 20 and rows[1].group_size == 4 and rows[20].kept and not rows[7].kept
    assert rows[21].group_size == 1 and rows[8].keep_id == 8


def test_bytes_decide_when_digests_clash(spark):
    docs = spark.createDataFrame([(i, f"word{i % 4}") for i in range(40)], "doc_id long, text string")
    rows = X.dedup(docs, digest=lambda t: F.lit("same")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [
        (i, 36 + i % 4, 10) for i in range(40)]


def test_keep_rows_keeps_columns(odd_docs, texts):
    rows = X.keep_rows(odd_docs)
    assert rows.columns == odd_docs.columns
    assert rows.count() == len(groups(texts))
