from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from entitylake.operators import quality


def by_group(rows):
    """The rule from each key's ordered rows: before, at and after the first acceptable one."""
    status = {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((seq, wrong) for seq, k, wrong in rows if k == key)
        first = next((i for i, (_, wrong) in enumerate(mine) if not wrong), len(mine))
        names = ["filtered"] * first + ["kept"] + ["duplicate"] * len(mine)
        status |= {seq: name for (seq, _), name in zip(mine, names)}
    return status


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_status_equals_its_definition_by_group(spark, seed, broadcast):
    rng = random.Random(seed)
    # Key 1 holds more than a third of the rows; a null key is one ordinary key.
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None, *range(4, 9)]), rng.random() < 0.5) for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, key long, wrong boolean").repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r.seq: r.status for r in quality.dedupe_status(df, "key", ["seq"], F.col("wrong")).collect()}
        kept = {r.seq for r in quality.dedupe(df, "key", ["seq"], F.col("wrong")).collect()}
        s = quality.dedupe_summary(df, "key", ["seq"], F.col("wrong")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    expected = by_group(rows)
    assert got == expected
    assert kept == {k for k, v in expected.items() if v == "kept"}
    values = list(expected.values())
    assert (s.total, s.kept, s.filtered, s.duplicates) == (
        800, values.count("kept"), values.count("filtered"), values.count("duplicate"),
    )


def test_key_without_acceptable_rows_is_filtered(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "x", True), (3, None, True)], "seq int, key string, wrong boolean")
    assert [r.status for r in quality.dedupe_status(df, "key", ["seq"], F.col("wrong")).orderBy("seq").collect()] == ["filtered"] * 3


def test_missing_type_is_unknown(spark):
    df = spark.createDataFrame([("artist",), ("album",), (None,)], "type string")
    assert {r.type for r in quality.keep_types(df, ("artist", "unknown")).collect()} == {"artist", None}
    assert {r.type for r in quality.keep_types(df).collect()} == {"artist"}
    assert [(r.type, r.n) for r in quality.type_counts(df).collect()] == [("album", 1), ("artist", 1), ("unknown", 1)]
    assert quality.filter_summary(df).first().asDict() == {"total": 3, "kept": 1, "filtered_out": 2, "retention": 33.333333}


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "type string")
    assert quality.filter_summary(df).first().retention is None
