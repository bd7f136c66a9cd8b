"""What the plans of all registered queries must and must not contain."""

from __future__ import annotations

import re

import pytest

from bindings import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry()
FORBIDDEN = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not [node for node in FORBIDDEN if node in plan], plan


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = plan_of(QUERIES["filter_types"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan
    assert re.search(r"PushedFilters: \[In\(c_mktsegment", plan)
    assert "ReadSchema: struct<event_type:string>" in plan_of(QUERIES["type_counts"](spark, SF))


def test_postings_need_no_shuffle(spark):
    from bindings import table
    from entitylake.operators import index

    docs = table(spark, SF, "documents")
    assert "Exchange" not in plan_of(index.postings(docs))


def test_extraction_is_one_narrow_pass(spark):
    from bindings import table
    from entitylake.operators.entities import extract_entities
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").select(F.col("source").alias("title"), "text")
    assert "Exchange" not in plan_of(extract_entities(docs))


@pytest.mark.parametrize("name", ["batch_search", "bm25", "eval_top1", "tfidf_smooth"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["limit_scan", "random_sample", "join_sample"])
def test_limits_are_top_n(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF))


def test_no_product_of_vocabulary_and_query_terms(spark):
    plan = plan_of(QUERIES["fuzzy_terms"](spark, SF))
    assert re.search(r"Join \[n#\d+, i#\d+, piece#\d+\]", plan)


def test_statistics_and_scores_share_one_scan(spark):
    from bindings import table
    from entitylake.operators import index, search

    docs = table(spark, SF, "documents").select("doc_id", "text")
    for df in (
        search.search_texts(docs, ["the and that"]),
        search.phrase_search(docs, "of the"),
        index.terms_of_texts(docs),
    ):
        df.collect()
        assert "ReusedExchange" in plan_of(df)
