import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from brandlens.llm import grammar_ids as X


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(X.VOCABULARY)
    t.encode_special_tokens = True
    return t


def expected(tokenizer, texts):
    at, out = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, X.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_of_odd_rows(spark, odd_docs, texts, tokenizer, tmp_path):
    out = str(tmp_path / "shards")
    X.write(odd_docs, out, shard_ids=50)
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in X.read(spark, out).collect()]
    assert sorted(rows, key=repr) == sorted(expected(tokenizer, texts), key=repr)


def test_empty_table(spark, no_docs, tmp_path):
    X.write(no_docs, str(tmp_path / "shards"))
    assert X.read(spark, str(tmp_path / "shards")).collect() == []


@pytest.mark.parametrize("n_terminals", [50, 1 << 20])
def test_grammar_is_exact_and_random_access_works(n_terminals):
    rng = random.Random(3)
    phrases = [[rng.randrange(3, 50) for _ in range(rng.randrange(2, 9))] for _ in range(20)]
    ids = np.array([x for _ in range(3000) for x in [*rng.choice(phrases), *([2] if rng.random() < 0.1 else [])]])
    rules, lengths, seq = X.compress(ids, n_terminals, 2, least=4)
    assert len(rules) and len(seq) < len(ids) / 2
    grammar = X.Grammar(rules, lengths, n_terminals)
    assert (grammar.expand(seq) == ids).all()
    for _ in range(50):
        a = rng.randrange(len(ids))
        n = rng.randrange(1, min(200, len(ids) - a) + 1)
        assert (grammar.read(seq, a, n) == ids[a:a + n]).all()
    # no rule reaches over the end of a document
    assert all(2 not in grammar.expand(np.array([k]))[:-1] for k in range(n_terminals, n_terminals + len(rules)))


@pytest.mark.parametrize("ids", [[], [5], [7, 7, 7, 7, 7, 7, 7, 7, 7], [2, 2, 2]])
def test_small_sequences(ids):
    rules, lengths, seq = X.compress(np.array(ids, np.uint32), 50, 2, least=2)
    assert X.Grammar(rules, lengths, 50).expand(seq).tolist() == ids


def test_words_are_forgotten_when_there_are_too_many(tokenizer):
    import pyarrow as pa

    words = X.WordIds(X.VOCABULARY, most=5)
    for text in ["one two three four five six", "Seven, eight. one é,", "it's l'été."]:
        ids, n = words.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_added_tokens_in_texts():
    """Texts that hold an added token: the ids of the library, with and without blanks around it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(X.VOCABULARY)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    texts = ["plain words first", ""]
    for a in added:
        texts += [a, f"{a} foo", f"foo{a}bar", f"foo {a}{a} bar.", a.upper(), f"half {a[:-1]}", f"\n{a}\t", "Between, two."]
    ids, n = X.word_ids(X.VOCABULARY).encode(pa.array(texts))
    ends = n.cumsum()
    for text, k, end in zip(texts, n.tolist(), ends.tolist(), strict=True):
        assert ids[end - k:end].tolist() == library.encode(text, add_special_tokens=False).ids, text
