import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brandlens.llm import byte_bpe as X


def expected(texts):
    enc = X.encoding(X.VOCABULARY, X.PATTERN)
    out = []
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(odd_docs, texts):
    rows = X.digests(odd_docs).drop("ids").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=repr) == expected(texts)


def test_small_blocks(odd_docs, texts):
    rows = X.encode(odd_docs, block_bytes=40).collect()
    assert sorted(((r.doc_id, len(r.ids) // 4) for r in rows), key=repr) == sorted(
        ((i, n) for i, n, _, _ in expected(texts)), key=repr)


def test_empty_table(no_docs):
    assert X.digests(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'st .,!\n\t\r\x01\x1c\x85\xa0 é日1", max_size=30), min_size=1, max_size=5))
def test_words_have_the_texts_pre_tokens(texts):
    enc = X.encoding(X.VOCABULARY, X.PATTERN)
    codes, n, words = X.split_words(pa.array(texts, pa.string()))
    ends, words = np.cumsum(n), words.to_pylist()
    for text, end, count in zip(texts, ends, n, strict=True):
        own = [words[c] for c in codes[end - count:end]]
        assert "".join(own) == text
        assert [i for w in own for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=50))
def test_packed_numbers(numbers):
    assert X.unpack_numbers(X.pack_numbers(np.array(numbers, np.uint32))).tolist() == numbers
