"""Linking two entity tables by normalised name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.operators.skew import SLICE_ROWS, join_skewed


def with_name_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """All columns plus the normalised ``key`` of ``column``."""
    return df.withColumn(key, X.name_key(column))


def link(
    left: DataFrame,
    right: DataFrame,
    left_name: str = "name",
    right_name: str = "title",
    left_key: str = "name_norm",
    right_key: str = "title_norm",
    rename_right: dict[str, str] | None = None,
    spread_left_by: list[str] | None = None,
    spread_right_by: list[str] | None = None,
    drop_empty_keys: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inner join, many to many, on the normalised names; null names drop out.

    All columns of both sides are kept; ``rename_right`` resolves collisions
    (``type`` and ``url`` by default).  Names without any ASCII letter or digit
    share the key ``''`` and match each other; ``drop_empty_keys`` leaves them out.
    Rows of a hot key (such as ``''``; more than ``slice_rows`` rows) are spread over
    slices by ``spread_..._by``, by default all plain columns of the side.
    """
    renames = {"type": "wiki_type", "url": "wiki_url"} if rename_right is None else rename_right
    a = with_name_key(left, left_name, left_key)
    b = with_name_key(right, right_name, right_key).withColumnsRenamed(
        {old: new for old, new in renames.items() if old in right.columns}
    )
    if drop_empty_keys:
        a = a.where(F.col(left_key) != "")
        b = b.where(F.col(right_key) != "")
    return join_skewed(
        a, b, left_key, right_key, spread_left_by or _plain(a), spread_right_by or _plain(b), slice_rows
    )


def _plain(df: DataFrame) -> list[str]:
    """Columns of string and number types: enough to tell rows of one key apart."""
    return [name for name, kind in df.dtypes if kind in ("string", "bigint", "int", "double")]


def link_stats(
    left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "title"
) -> DataFrame:
    """One row: sizes of both sides, joined rows, distinct matched names, match rate in percent.

    No pair is produced: each side is reduced to one row per key holding the number
    of rows and of distinct names, and the joined size is the sum of products.
    The match rate divides distinct matched names by all left rows, 0 when there are none.
    """

    def per_key(df: DataFrame, name: str, side: str) -> DataFrame:
        by_name = df.groupBy(X.name_key(name).alias(f"{side}_key"), name).agg(
            F.count(F.lit(1)).alias("n")
        )
        return by_name.groupBy(f"{side}_key").agg(
            F.sum("n").alias(f"{side}_rows"), F.count(name).alias(f"{side}_names")
        )

    a, b = per_key(left, left_name, "left"), per_key(right, right_name, "right")
    both = a.join(b, F.col("left_key") == F.col("right_key"), "full")
    hit = F.col("left_key").isNotNull() & F.col("right_key").isNotNull()

    def total(value, condition=None):
        value = F.col(value) if isinstance(value, str) else value
        return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0))

    sums = both.agg(
        total("left_rows").alias("left_total"),
        total("right_rows").alias("right_total"),
        total(F.col("left_rows") * F.col("right_rows"), hit).alias("joined"),
        total("left_names", hit).alias("left_matched"),
        total("right_names", hit).alias("right_matched"),
    )
    rate = F.when(F.col("left_total") > 0, F.col("left_matched") * 100 / F.col("left_total"))
    return sums.withColumn("match_rate", F.round(F.coalesce(rate, F.lit(0.0)), 6))
