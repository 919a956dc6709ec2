"""Properties from the test strategy: idempotence, monotonicity, incremental = full run."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandlens.config import BrandProfile
from brandlens.operators.dedup import dedup_first
from brandlens.operators.enrich import enrich_incremental
from brandlens.operators.gates import relevance_gate
from brandlens.plans.stand_ins import stand_in_model

WORDS = ["acme", "app", "motor", "happy", "bug", "crash", "fine", "great"]
SCHEMA = "platform string, id string, seq long, title string, text string"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["r", "t"]), st.integers(0, 6)), min_size=1, max_size=25))
def test_dedup_first_is_idempotent_and_keeps_first(spark, keys):
    rows = [(p, str(k), i, None, f"v{i}") for i, (p, k) in enumerate(keys)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = sorted(map(tuple, dedup_first(df).collect()))
    twice = sorted(map(tuple, dedup_first(dedup_first(df)).collect()))
    assert once == twice
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1]), r)
    assert once == sorted(first.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=6), min_size=1, max_size=15),
       st.lists(st.sampled_from(WORDS), max_size=3))
def test_gate_is_monotone_in_blocklist(spark, texts, extra_block):
    df = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    small = BrandProfile(brand="acme", blocklist=("motor",), keywords=("app",))
    big = BrandProfile(brand="acme", blocklist=("motor", *extra_block), keywords=("app",))
    a = [r[0] for r in df.select(relevance_gate(small, F.lit(""), "text")).collect()]
    b = [r[0] for r in df.select(relevance_gate(big, F.lit(""), "text")).collect()]
    assert all(x or not y for x, y in zip(a, b))  # passing the bigger blocklist implies passing the smaller


def test_model_sees_each_batch_once_and_a_killed_run_goes_on(spark, tmp_path):
    from brandlens.operators.classify import assign_batches, batch_prompts, stored_answers
    import pytest
    log = tmp_path / "calls"
    log.write_text("")
    rows = [("r", str(i), i, None, f"post number {i}") for i in range(23)]
    cur = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.lit(None).cast("timestamp_ntz"))
    p = BrandProfile(brand="acme", variants=("acmex",), reference_query="post")
    path = str(log)

    def counting(prompts):
        with open(path, "a") as f:
            f.write("x\n" * len(prompts))
        return [stand_in_model([x])[0] for x in prompts]

    out, meta = enrich_incremental(cur, None, p, counting, search=False, answers=str(tmp_path / "answers"),
                                   backend="stand-in")
    m = meta.first()
    assert out.count() == 23 and (m.total, m.new_this_run, m.llm_backend, m.llm_enriched, m.search_enriched) == (
        23, 23, "stand-in", True, False)
    assert m.by_platform == {"r": 23} and sum(m.by_topic.values()) == 23
    assert len(log.read_text().split()) == 5

    def dying(prompts):
        if any("post number 22" in x for x in prompts):
            raise SystemExit  # the worker dies, and with it the run
        return counting(prompts)

    log.write_text("")
    prompts = batch_prompts(assign_batches(cur, [F.col("seq").asc()]))
    store = str(tmp_path / "again")
    with pytest.raises(Exception):
        stored_answers(prompts, dying, store, wave=2, tasks=1)
    before = len(log.read_text().split())
    assert stored_answers(prompts, counting, store, wave=2, tasks=1).count() == 5
    assert before == 4 and len(log.read_text().split()) == 5


def test_answers_one_job_at_any_number_of_waves(spark, tmp_path):
    from brandlens.operators.classify import stored_answers
    calls = str(tmp_path / "calls")

    def counting(prompts):
        with open(calls, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        return [f"answer to {p}" for p in prompts]

    def jobs(store, prompts):
        spark.sparkContext.setJobGroup(store, store)
        rows = stored_answers(prompts, counting, store, wave=2, tasks=3).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(store))

    # two batches may have the same prompt; it is asked once
    many = spark.createDataFrame([(b, 5, f"p{b % 70}") for b in range(90)], "batch_id long, n int, prompt string")
    few = many.filter("batch_id < 2")
    rows, wide = jobs(str(tmp_path / "many"), many)
    assert {(r.batch_id, r.response, r.error) for r in rows} == {(b, f"answer to p{b % 70}", None) for b in range(90)}
    assert sorted(open(calls).read().split()) == sorted(f"p{i}" for i in range(70))
    assert jobs(str(tmp_path / "few"), few)[1] == wide
    assert jobs(str(tmp_path / "none"), many.limit(0))[0] == []
    # a folder named by URI, half-written files in it are not read
    (tmp_path / "many" / ".left-over").write_text("half a file")
    open(calls, "w").close()
    again = stored_answers(many, counting, f"file:{tmp_path / 'many'}", wave=7, tasks=2)
    assert again.count() == 90 and open(calls).read() == ""


def test_a_task_tried_again_goes_on_behind_its_files(spark, tmp_path):
    """The files of a task whose rows were lost are there; the same prompts are not asked again."""
    from brandlens.operators.classify import stored_answers
    import pytest
    calls, store = str(tmp_path / "calls"), str(tmp_path / "store")
    prompts = spark.createDataFrame([(b, 1, f"p{b:02}") for b in range(20)], "batch_id long, n int, prompt string")

    def dies_late(some):
        if "p15" in some:
            raise SystemExit
        with open(calls, "a") as f:
            f.write("".join(p + "\n" for p in some))
        return list(some)

    def counting(some):
        with open(calls, "a") as f:
            f.write("".join(p + "\n" for p in some))
        return list(some)

    with pytest.raises(Exception):
        stored_answers(prompts, dies_late, store, wave=4, per_call=4, tasks=1)
    assert stored_answers(prompts, counting, store, wave=4, per_call=4, tasks=1).count() == 20
    assert sorted(open(calls).read().split()) == [f"p{b:02}" for b in range(20)]


def test_incremental_twice_equals_once(spark):
    p = BrandProfile(brand="acme", variants=("acmex",), reference_query="acme app crash")
    rows = [("r", str(i), i, None, f"acme app {'crash bug' if i % 3 == 0 else 'great fine'} number{i} longword{i}")
            for i in range(23)]
    cur = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.lit(None).cast("timestamp_ntz"))
    first, meta1 = enrich_incremental(cur, None, p, stand_in_model)
    first_rows = first.collect()
    assert meta1.first().new_this_run == len(rows)
    prev = spark.createDataFrame(first_rows, first.schema).drop("is_new")
    second, meta2 = enrich_incremental(cur, prev, p, stand_in_model)
    cols = ["platform", "id", "relevance", "topic", "llm_sentiment", "key_phrases", "is_critical"]
    # every row got >= 1 key phrase in the first run, so nothing is new the second time
    assert all(r.key_phrases for r in first_rows)
    assert meta2.first().new_this_run == 0
    assert sorted(map(tuple, second.select(*cols).collect())) == sorted(map(tuple, first.select(*cols).collect()))
