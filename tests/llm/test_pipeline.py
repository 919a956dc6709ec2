"""The pipeline and the queries on the small tables."""

import hashlib

import corpus_pipeline as P
import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from brandlens.llm import byte_bpe, queries


def test_stages_on_small_tables(spark, sf, tmp_path):
    docs, counts = P.table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in P.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    items = [" ".join(r[0].split()) for r in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]
    # exact dedup leaves each folded text once
    assert counts[1] <= len({t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                             for t in texts.values()})
    enc = byte_bpe.encoding(byte_bpe.VOCABULARY, byte_bpe.PATTERN)
    for r in docs.collect():
        text = texts[r.doc_id]
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert not any(item in " ".join(text.split()) for item in items)


def test_pipeline_of_odd_and_empty_tables(spark, sf, odd_docs, no_docs, tmp_path):
    from pyspark.sql import functions as F

    for k, docs in enumerate((odd_docs.withColumn("lang", F.lit("xx")), no_docs)):
        columns = docs.columns
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            if name != P.STAGES[-1][0]:
                assert out.columns == columns
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        if k:
            assert docs.count() == 0
        else:
            # 3, 4, 7, 8 have no letter, 10 shares no n-gram with a language; 1 and 2 are equal but
            # for case, 5 is there twice
            ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
            assert [i for i in ids if i != 6] == [2, 5, 9, 11]


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_for_each_operator(number):
    names = [q for q in E.queries() if q.startswith(f"op{number}_")]
    assert len(names) == 1
    assert E.queries()["pipeline"] is P.run


def test_registered_oracles():
    assert set(queries.ORACLE) <= set(queries.QUERIES)


CONTRACT = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_grammar_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_contamination": "doc_id bigint, item_id bigint, distance int, item_words int, place bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_private_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                        "base_sha256 string, spans string",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_pivot_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                            "folded_root string, verified boolean",
    "op13_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_runs_over_its_whole_table(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf)
    assert ", ".join(" ".join(x) for x in rows.dtypes) == CONTRACT[name]
    key = next(c for c in rows.columns if c.endswith("_id"))
    table = {"page_id": "pages", "vec_id": "embeddings"}.get(key, "documents")
    ids = sorted(r[0] for r in duckdb.sql(f"SELECT {key} FROM '{sf}/{table}.parquet'").fetchall())
    found = sorted(r[key] for r in rows.select(key).collect())
    assert found == ids if name != "op3_contamination" else set(found) <= set(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM read_parquet('{sf}/{name_of}.parquet')")
    expected = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in expected.description]
    rows = queries.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(expected.fetchall(), key=repr)


def test_near_copies_of_five_word_shingles_go(spark):
    """Two of 100 words replaced: 0.811 similar by five words, 0.848 by four."""
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    for at in (30, 60):
        near[at] = "other"
    for at in (20, 50, 80):  # three replaced: 0.73 by five words
        far[at] = "third"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(P.STAGES)["similar documents"](spark, docs, "").collect()) == [1, 3]
