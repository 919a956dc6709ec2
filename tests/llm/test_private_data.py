import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brandlens.llm import private_data as X

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def passes(kind, match):
    number = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 16 <= len(number) <= 19 and luhn(number), "phone": 8 <= len(number) <= 15}[kind]


def expected(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m.group())] for k, p in PLAIN.items()}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = X.find(docs).collect()
    return {r.doc_id: {k: [(s.start, s.end) for s in r[k]] for k in X.KINDS} for r in rows}


TEXTS = ["a@b.c d@e.f_x@y.zz a@b.c_x@d.e", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 00001.2.3.4",
         "4111 1111-1111 1111 4111111111111111 " + "1" * 5000 + " " + "1 " * 9000,
         "+1 (644) 555-7859 +12 +1-2-3-4-5-6-7-8 ++49 30 1234567.", "é@x.y 日本 foo@bar.com 1.2.3.4", "", "x" * 50_000]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    assert found(spark, TEXTS) == {i: expected(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.+-()@ ab_é", max_size=60), min_size=20, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    assert found(spark, texts) == {i: expected(t) for i, t in enumerate(texts)}


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    good = [(i, f"please call +49 30 {1234567 + i} or write mail: user{i}@host{i}.example today") for i in range(9)]
    # after the word that leads seeds, same shape of signs, but no base pattern
    new = [(100, "write mail: user12(at)host.example or"), (101, "old ip address 300.1.2.3 was"),
           (102, "released in version 12.5 of the"), (103, "the year 1987 and")]
    ips = [(200 + i, f"old ip address 10.1.2.{i} was") for i in range(9)]
    docs = spark.createDataFrame(good + new + ips, "doc_id long, text string")
    rows = {r.doc_id: [(s.start, s.end) for s in r.context] for r in X.find(docs).collect()}
    assert rows[101] == [(15, 24)]
    assert rows[102] == [] and rows[103] == [] and all(rows[i] == [] for i, _ in good + ips)


def context_of(spark, texts, rounds=X.ROUNDS):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.context] for r in X.find(docs, rounds).collect()}


def test_found_identifiers_teach_further_patterns(spark):
    # mails are seeds; the members after the same key are found by it; the last one shares no
    # context with a seed and is reached over the signature of the members only
    texts = {i: f"{'x' * (i % 7 + 1)} contact: user{i}@host{i}.example is known" for i in range(80)}
    texts |= {100 + i: f"{'y' * (i + 1)} contact: MBR-{4107 + 13 * i}q was here" for i in range(8)}
    texts |= {200: "somewhere else MBR-9921q stood", 201: "see ISO-9921q, part 12 of 1987"}
    once, later = context_of(spark, texts, 1), context_of(spark, texts)
    assert all(once[100 + i] == later[100 + i] == [f"MBR-{4107 + 13 * i}q"] for i in range(8))
    assert once[200] == [] and later[200] == ["MBR-9921q"]
    assert later[201] == [] and all(later[i] == [] for i in range(80))


def test_contexts_after_alone_and_by_key(spark):
    texts = {i: f"{'x' * (i + 1)} u{i}@h{i}.example wrote" for i in range(9)}
    texts |= {20 + i: f"heading{'s' * i}\n+49 30 {7654321 - i}\nfooter" for i in range(9)}
    texts |= {40 + i: f"{'z' * (i + 1)} password = s3cr3t{i}x" for i in range(9)}
    texts |= {60: "then u1_h1.example wrote", 61: "title\n+49 30 12\nmore", 62: "password = hunter",
              63: "+49 30 12 in a line", 64: "sum = total"}
    found = context_of(spark, texts)
    assert found[40] == ["s3cr3t0x"] and found[62] == ["hunter"]
    assert found[63] == found[64] == [] and all(found[i] == [] for i in [*range(9), *range(20, 29)])


def test_numbers_of_a_card_that_fail_the_check_digit(spark):
    bodies = [str(411111111111000 + 7 * i) for i in range(40)]
    valid = [next(b + d for d in "0123456789" if luhn(b + d)) for b in bodies]
    wrong = [v[:-1] + str((int(v[-1]) + 1) % 10) for v in valid[:30]]
    orders = [f"{10**17 + 7919 * i}" for i in range(80)]  # a tenth of them passes by chance
    texts = {i: f"{'a' * (i + 1)} {n} {'b' * (i + 1)}" for i, n in enumerate(valid + wrong + orders)}
    found = context_of(spark, texts | {500: "in 1987 and 12345678901234 or 4.0"})
    assert sum(map(luhn, orders)) >= X.SEEDS
    for i, number in enumerate(valid + wrong + orders):
        assert found[i] == ([number] if number in wrong else [])
    assert found[500] == []


def test_joined_numbers_and_whole_context(spark):
    texts = {i: f"{'x' * (i + 1)} account 2 +49 30 {1234567 + i} ok" for i in range(9)}
    spans = context_of(spark, texts | {50: "r account 2 0151 2233 4455 ok", 51: "2 0151 2233 9999"})
    assert all(spans[i] == [] for i in range(9)) and spans[51] == []
    (row,) = X.occurrences(spark.createDataFrame([(1, "tel 0151 2233 4455, (12 34) a_b \u00e9")],
                                                 "doc_id long, text string")).select("others").collect()
    assert [(o.start, o.end, o.core, o.before) for o in row.others] == [
        (4, 18, "0151 2233 4455", "tel "), (21, 26, "12 34", "tel 0151 2233 4455, "), (28, 31, "a_b", "tel 0151 2233 4455, (12 34) ")]


def test_few_seeds_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "ip 10.0.0.1"), (2, "ip 300.0.0.1")], "doc_id long, text string")
    assert all(r.context == [] for r in X.find(docs).collect())


def test_odd_rows(spark, odd_docs, texts, no_docs):
    rows = X.find(odd_docs).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in texts), key=repr)
    assert X.find(no_docs).collect() == []


def test_no_python_in_the_plan(spark, odd_docs):
    plan = X.find(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
