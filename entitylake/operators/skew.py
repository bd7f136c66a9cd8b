"""Equi-joins in which one key may hold a large share of the rows.

A key is *hot* when it holds more rows than one task should, ``SLICE_ROWS``; it is cut
into as many slices as that takes, so no task has more whatever the size of the data.
How many keys are hot grows with the data, so their counts are joined as Spark decides by
size and never broadcast by a hint.  All other rows are joined as usual.  Adaptive skew
handling remains the second line of defence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 100_000
LOOKUP_SLICES = 4096


def hot_keys(rows: DataFrame, key: str, name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(<name>_key, <name>_slices) of the hot keys, null left out.

    Counting reads the key column only and is pre-aggregated before the shuffle.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > slice_rows).select(
        F.col(key).alias(f"{name}_key"), F.ceil(F.col("n") / slice_rows).cast("int").alias(f"{name}_slices")
    )


def _sliced(rows: DataFrame, key: str, hot: DataFrame, name: str, by: Sequence[str] | None, slice_name: str) -> DataFrame:
    """Add the slice number within the key: one chosen by a hash of ``by``, or all of them."""
    marked = rows.join(hot, F.col(key) == F.col(f"{name}_key"), "left")
    slices = F.col(f"{name}_slices")
    number: Column
    if by is not None:
        number = F.when(slices.isNotNull(), F.pmod(F.xxhash64(*by), slices)).otherwise(0).cast("int")
    else:
        number = F.explode(
            F.when(slices.isNotNull(), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.lit(0)))
        )
    return marked.withColumn(slice_name, number).drop(f"{name}_key", f"{name}_slices")


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread_left_by: Sequence[str],
    spread_right_by: Sequence[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inner join, many to many, with hot keys of either side cut into slices.

    The column names of both sides must differ; ``spread_..._by`` names columns
    that vary among the rows of one key.  A row of a hot key sits in one slice of
    its own side and is copied to all slices of the other side, so every pair
    meets exactly once, and copies number at most the pairs over ``slice_rows``.
    """
    hot_left = hot_keys(left, left_key, "_hot_left", slice_rows)
    hot_right = hot_keys(right, right_key, "_hot_right", slice_rows)
    a = _sliced(left, left_key, hot_left, "_hot_left", spread_left_by, "_l1")
    a = _sliced(a, left_key, hot_right, "_hot_right", None, "_l2")
    b = _sliced(right, right_key, hot_left, "_hot_left", None, "_r1")
    b = _sliced(b, right_key, hot_right, "_hot_right", spread_right_by, "_r2")
    meet = (
        (F.col(left_key) == F.col(right_key))
        & (F.col("_l1") == F.col("_r1"))
        & (F.col("_l2") == F.col("_r2"))
    )
    return a.join(b, meet, "inner").drop("_l1", "_l2", "_r1", "_r2")


def lookup_skewed(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    value: str,
    n: str,
    spread_by: Sequence[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``rows`` with the ``value`` that ``per_key`` (one row per key) holds for their key.

    ``per_key(key, value, n)`` has the number of rows per key.  The few hot keys meet
    their rows in a join of its own, broadcast by size or split by adaptive skew
    handling; those rows are spread evenly in the join with all others.  Keys must not
    be null.
    """
    hot = per_key.where(F.col(n) > slice_rows).select(
        F.col(key).alias("_hot_key"), F.struct(value).alias("_hot_value")
    )
    marked = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_slice",
        F.when(
            F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.lit(LOOKUP_SLICES))
        ).otherwise(F.lit(-1).cast("long")),
    )
    # Read off a column so that the slice stays a join key: a literal would become a mere
    # filter on the left and leave all rows of a hot key in one bucket.
    no_slice = F.when(F.col(n) > 0, F.lit(-1)).otherwise(F.lit(-2)).cast("long")
    others = per_key.select(
        F.col(key).alias("_other_key"), F.struct(value).alias("_other_value"), no_slice.alias("_no_slice")
    )
    meet = (F.col(key) == F.col("_other_key")) & (F.col("_slice") == F.col("_no_slice"))
    found = marked.join(others, meet, "left")
    return found.withColumn(value, F.coalesce("_hot_value", "_other_value")[value]).drop(
        "_hot_key", "_hot_value", "_slice", "_other_key", "_other_value", "_no_slice"
    )
