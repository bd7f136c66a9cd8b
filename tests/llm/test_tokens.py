from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from entitylake.llm import tokens
from entitylake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁é\n\t.漢<s>/"), min_size=1, max_size=30))
def test_parts_add_up_to_the_whole(text):
    lengths = tokens.Lengths({}, LIBRARY.encode)
    assert sum(lengths[p] for p in tokens.pre_tokens(text)) == len(LIBRARY.encode(text))


def test_pieces_that_cross_parts_are_found():
    assert tokens.crossing_pieces(["▁a", "▁▁", "a▁b"]) == ["a▁b"]


def test_counts_equal_the_library(odd_docs):
    found = tokens.token_counts(odd_docs, MODEL, token_limit=100)
    assert found.columns == ["doc_id", "text", "source", "score", "n_bytes", "n_tokens", "over_limit"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(LIBRARY.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 100)


def test_a_full_cache_changes_nothing(monkeypatch):
    lengths = tokens.Lengths({}, LIBRARY.encode)
    lengths.room = 1
    assert [lengths[p] for p in ("alpha", "beta", "alpha", "beta")] == [len(LIBRARY.encode(p)) for p in ("alpha", "beta", "alpha", "beta")]
    assert set(lengths) == {"", "alpha"}


def test_empty_table(no_docs):
    assert tokens.token_counts(no_docs, MODEL).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_token_counts"](spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(LIBRARY.encode(t)) for d, t in texts.items()}


@pytest.mark.parametrize("text", [" a", "a ", "a  b", "  ", "a\n b"])
def test_spaces(text):
    lengths = tokens.Lengths({}, LIBRARY.encode)
    assert sum(lengths[p] for p in tokens.pre_tokens(text)) == len(LIBRARY.encode(text))
