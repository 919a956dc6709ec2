"""Rows that every operator of the subpackage must cope with."""

import random

import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "the QUICK brown fox jumps over the lazy dog."),
    (3, None),
    (4, ""),
    (None, "A text without an id, but with words enough to be a shingle."),
    (5, "repeated row"), (5, "repeated row"),
    (6, "same id, first text"), (6, "same id, second text"),
    (7, " \t\n"),
    (8, "12 34 ... !!"),
    (9, "Ünïcödé 日本語 text with  odd\x1cspace \x01 and 'quotes' don't"),
    (10, "a"),
]


def long_text(words: int = 40_000) -> str:
    rng = random.Random(5)
    vocabulary = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    return " ".join(rng.choices(vocabulary, k=words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names
    operators use themselves."""
    rows = [(i, t, "x", 1, True, -1.0) for i, t in [*ODD, (11, long_text())]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, keep string, n int, kept boolean, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the odd rows, null texts as empty."""
    return [(i, t or "") for i, t in [*ODD, (11, long_text())]]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
