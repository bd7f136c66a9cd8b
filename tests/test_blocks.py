"""Retrieval over posting blocks against the scoring of everything."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.operators import blocks, index, search
from entitylake.sources import writers

QUERIES = ["w1 w2", "w40 w3", "rare7", "w0", "w0 w0 w90 rare3", "nowhere", "", "w5 w6 w7 w8 w9 w10"]


def texts(n=400):
    """Words of falling frequency; every document has w0, so it is in every block."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = ["w0"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 60))]
        if i % 37 == 0:
            words += [f"rare{i // 37}"] * rng.randint(1, 4)
        rows.append((i * 3, " ".join(words), "odd" if i % 2 else "even"))
    return rows + [(5000, "", "odd"), (5001, None, None), (5002, "...", "odd")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, content string, kind string").repartition(3)


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks"))
    writers.write_block_index(docs, path, ["content"], ["kind"], block_docs=20)
    return writers.read_block_index(spark, path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def exhaustive(docs, queries, weight, top, field="content"):
    found = index.field_occurrences(docs, ["content"], ["kind"])
    return rows(search.search_field(found, index.field_totals(found), queries, field, weight, top))


@pytest.mark.parametrize("weight, top", [("bm25", 1), ("bm25", 3), ("tfidf_smooth", 2), ("tfidf_classic", 1000)])
def test_equals_scoring_of_all_documents(docs, stored, weight, top):
    assert rows(blocks.search_blocks(stored, QUERIES, "content", weight, top)) == exhaustive(docs, QUERIES, weight, top)


def test_a_table_of_queries_and_an_exact_field(spark, docs, stored):
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, "w1 w2", None]], "query string")
    assert rows(blocks.search_blocks(stored, asked, top=5)) == exhaustive(docs, asked, "bm25", 5)
    exact = blocks.search_blocks(stored, ["odd"], "kind", top=4)
    assert rows(exact) == exhaustive(docs, ["odd"], "bm25", 4, "kind")


def test_tables_of_the_index(docs, stored):
    found = index.field_postings(docs, ["content"], ["kind"]).where("term IS NOT NULL")
    back = stored.blocks.select("field", "term", F.inline("postings")).select("field", "term", "doc_id", "tf", "doc_len")
    assert rows(back) == rows(found)
    totals = {r["field"]: (r["n_docs"], r["total_len"]) for r in stored.totals.collect()}
    expected = index.field_totals(index.field_occurrences(docs, ["content"], ["kind"]))
    assert totals == {r["field"]: (r["n_docs"], r["total_len"]) for r in expected.collect()}
    df = {(r["field"], r["term"]): r["df"] for r in stored.terms.collect()}
    assert df == {(r["field"], r["term"]): r["n"] for r in found.groupBy("field", "term").agg(F.count("*").alias("n")).collect()}
    wrong = stored.bounds.where("first_doc > last_doc OR n > 40 OR max_norm <= 0 OR max_tf < 1")
    assert wrong.count() == 0
    spans = stored.bounds.where("term = 'w0'").orderBy("block").collect()
    assert len(spans) > 10 and all(a["last_doc"] < b["first_doc"] for a, b in zip(spans, spans[1:]))


def opened(stored, query, top):
    asked = blocks.asked_terms(stored, [query], "content", X.words)
    bounds = blocks.query_bounds(stored, asked, "content", "bm25")
    return blocks.promising(stored, bounds, "content", "bm25", top).count(), bounds.count()


def test_blocks_that_cannot_win_are_not_opened(stored):
    """A rare term decides: of the blocks with the stop word only those with the rare one are read."""
    read, all_blocks = opened(stored, "w0 rare3", 1)
    assert all_blocks > 15 and read <= 2
    read, all_blocks = opened(stored, "w0 w1 w2", 1)
    assert read < all_blocks
    # nothing to skip where all matches are wanted
    assert opened(stored, "w0 rare3", 1000)[0] == all_blocks


def test_bounds_are_never_exceeded(stored):
    asked = blocks.asked_terms(stored, QUERIES[:6], "content", X.words)
    for weight in ("bm25", "tfidf_smooth"):
        bounds = blocks.query_bounds(stored, asked, "content", weight)
        scores = blocks.score_blocks(stored, bounds, "content", weight)
        of_doc = stored.blocks.where("term = 'w0'").select("block", F.inline("postings")).select("block", "doc_id")
        over = scores.join(of_doc, "doc_id").join(bounds, ["query", "block"]).where("score > bound + 0.000001")
        assert over.count() == 0


def test_a_stop_word_is_cut_into_slices(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "SLICE_BLOCKS", 4)
    writers.write_block_index(docs, str(tmp_path / "i"), ["content"], block_docs=20)
    cut = writers.read_block_index(spark, str(tmp_path / "i"))
    terms = {r["term"]: r["slices"] for r in cut.terms.collect()}
    assert len(terms["w0"]) >= 5 and len(terms["rare7"]) == 1
    assert rows(blocks.search_blocks(cut, QUERIES, top=3)) == exhaustive(docs, QUERIES, "bm25", 3)


def test_no_documents(spark, docs, tmp_path):
    writers.write_block_index(docs.limit(0), str(tmp_path / "i"), ["content"])
    assert blocks.search_blocks(writers.read_block_index(spark, str(tmp_path / "i")), QUERIES).count() == 0


def test_terms_are_counted_behind_the_blocks_and_postings_move_once(docs):
    """The sample of a range computes all that stands before it, so no term is counted there."""
    counted = blocks.counted_fields(blocks.in_blocks(docs, 20), ["content"])
    found = counted._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in found and found.index("regexp_extract_all") < found.index("rangepartitioning")
    plan = blocks.posting_blocks(counted, blocks.block_totals(counted))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(field, \w+", re.sub(r"#\d+L?", "", plan))
    assert "rangepartitioning(field" not in plan and dealt.count("hashpartitioning(field, bucket") == 1
    assert "hashpartitioning(field, term" not in dealt


def test_few_asked_terms_leave_the_postings_where_they_are(stored):
    """Only rows of asked terms go on from the scan; the table of postings is not shuffled."""
    asked = blocks.asked_terms(stored, ["w0 rare3"], "content", X.words)
    scores = blocks.score_blocks(stored, blocks.query_bounds(stored, asked, "content", "bm25"), "content", "bm25")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
