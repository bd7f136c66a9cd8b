from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylake.operators import link, quality, skew
from tests.test_plans import plan_of


@pytest.fixture
def sort_merge(spark):
    """No automatic broadcast: the joins of large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def sides(spark, n=3000):
    """A third of each side has the empty key; one more key is hot on the left only."""
    i = F.col("id")
    left = spark.range(n).select(
        i.alias("a"), F.when(i % 3 == 0, "椎名").when(i % 3 == 1, "The Hot").otherwise(F.concat(F.lit("n"), i % 400)).alias("name")
    )
    right = spark.range(n // 10).select(
        i.alias("b"), F.when(i % 3 == 0, "林檎").when(i == 1, "hot!").when(i == 2, None).otherwise(F.concat(F.lit("N"), i)).alias("title")
    )
    return left, right


def keys(names):
    return [None if n is None else re.sub(r"[^a-zA-Z0-9 ]", "", re.sub(r"(?i)^(the|a|an)\s+", "", n)).strip().lower() for n in names]


def test_link_equals_the_plain_join_with_hot_keys(spark, sort_merge):
    left, right = sides(spark)
    left_rows, right_rows = left.collect(), right.collect()
    a = [(r.a, k) for r, k in zip(left_rows, keys([r.name for r in left_rows]))]
    b = [(r.b, k) for r, k in zip(right_rows, keys([r.title for r in right_rows]))]
    expected = Counter((x, y) for x, k in a for y, m in b if k is not None and k == m)
    got = Counter((r.a, r.b) for r in link.link(left, right, slice_rows=100).collect())
    assert got == expected and sum(got.values()) > 100_000


def test_hot_keys_are_found_by_their_rows(spark):
    left, _ = sides(spark)
    keyed = link.with_name_key(left, "name", "k")
    hot = {r.x_key: r.x_slices for r in skew.hot_keys(keyed, "k", "x", slice_rows=300).collect()}
    assert hot == {"": 4, "hot": 4}
    assert skew.hot_keys(keyed, "k", "x").count() == 0  # one task can hold them


def test_many_large_keys_are_sliced_though_none_has_a_large_share(spark, sort_merge, no_adaptive):
    left = spark.range(90_000).select(F.col("id").alias("a"), F.concat(F.lit("key "), F.col("id") % 300).alias("name"))
    right = spark.range(300).select(F.col("id").alias("b"), F.concat(F.lit("key "), F.col("id")).alias("title"))
    assert {r.x_slices for r in skew.hot_keys(left, "name", "x", slice_rows=100).collect()} == {3}
    joined = link.link(left, right, slice_rows=100)
    assert joined.count() == 90_000
    parts = rows_per_task(joined)
    assert len(parts) == 8 and max(parts) < 1.5 * min(parts)


def test_slices_are_join_keys(spark, sort_merge):
    left, right = sides(spark)
    plan = plan_of(link.link(left, right, slice_rows=100))
    assert re.search(r"SortMergeJoin \[name_norm#\d+, _l1#\d+, _l2#\d+\]", plan)
    rows = left.select("a", "name", (F.col("a") % 5 == 0).alias("w"))
    plan = plan_of(quality.dedupe_status(rows, "name", ["a"], F.col("w"), slice_rows=100))
    assert re.search(r"SortMergeJoin \[_key#\d+, _slice#\d+L\]", plan)
    assert "Window" not in plan


@pytest.fixture
def no_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def rows_per_task(df):
    counted = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return [r.n for r in counted.collect()]


def test_hot_rows_are_spread_evenly(spark, sort_merge, no_adaptive):
    left, right = sides(spark, 6000)
    parts = rows_per_task(link.link(left, right.where("b < 9"), slice_rows=4).where("name_norm = ''"))
    assert len(parts) == 8 and max(parts) < 2 * min(parts)
    rows = left.select("a", "name", (F.col("a") % 5 == 0).alias("w"))
    parts = rows_per_task(quality.dedupe_status(rows, "name", ["a"], F.col("w"), slice_rows=100).where("name = '椎名'"))
    assert len(parts) == 8 and max(parts) < 2 * min(parts)


def test_drop_empty_keys(spark):
    left, right = sides(spark, 300)
    assert link.link(left, right, drop_empty_keys=True).where("name_norm = ''").count() == 0
    assert link.link(left, right).where("name_norm = ''").count() == 100 * 10


def test_collisions_are_renamed(spark):
    left = spark.createDataFrame([("X", "group", "u1")], "name string, type string, url string")
    right = spark.createDataFrame([("The x!", "band", "u2")], "title string, type string, url string")
    row = link.link(left, right).first().asDict()
    assert row == {
        "name": "X", "type": "group", "url": "u1", "name_norm": "x",
        "title": "The x!", "wiki_type": "band", "wiki_url": "u2", "title_norm": "x",
    }


def test_link_stats_equal_the_joined_rows(spark):
    left, right = sides(spark, 600)
    joined = link.link(left, right).collect()
    s = link.link_stats(left, right).first()
    assert s.joined == len(joined)
    assert s.left_matched == len({r.name for r in joined}) and s.right_matched == len({r.title for r in joined})
    assert (s.left_total, s.right_total) == (600, 60)
    assert s.match_rate == pytest.approx(s.left_matched / 600 * 100)


def test_link_stats_of_nothing(spark):
    left, right = sides(spark, 30)
    s = link.link_stats(left.where("a < 0"), right).first()
    assert (s.joined, s.left_total, s.match_rate) == (0, 0, 0.0)


def test_many_to_many(spark):
    left = spark.createDataFrame([(1, "A-ha"), (2, "Aha"), (3, None)], "a int, name string")
    right = spark.createDataFrame([(1, "aha"), (2, "A ha"), (3, "the aha"), (4, None)], "b int, title string")
    assert {(r.a, r.b) for r in link.link(left, right).collect()} == {(1, 1), (2, 1), (1, 3), (2, 3)}
