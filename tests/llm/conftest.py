from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

#: Texts with the cases that every operator has to stand.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line of the same short text follows here."),
    (2, "The quick brown fox jumps over the lazy dog.\nA second line of the same short text follows here."),
    (3, None),
    (4, ""),
    (5, "   \n\t \n"),
    (6, "one"),
    (7, "Ünïcödé wörds, 漢字 and 🙂 <|endoftext|> </s> x  y   z "),
    (8, "word " * 30_000 + "end"),
    (9, "x" * 50_000),
    (None, "A row without an id has this text and no other row has it."),
    (1, "The quick brown fox jumps over the lazy dog.\nA second line of the same short text follows here."),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "a" if i and i % 2 else None, 7, "kept") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, n_tokens string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return SF
