"""Type filter, ordered deduplication and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.operators.skew import SLICE_ROWS, lookup_skewed

DEFAULT_TYPES = ("artist", "band")
MISSING_TYPE = "unknown"


def type_of(column: str = "type") -> Column:
    return F.coalesce(column, F.lit(MISSING_TYPE))


def keep_types(df: DataFrame, types: tuple[str, ...] = DEFAULT_TYPES, column: str = "type") -> DataFrame:
    """Rows whose type is listed; a missing type counts as ``unknown``.

    Without ``unknown`` in the list the predicate is a plain ``IN`` that reaches the scan.
    """
    if MISSING_TYPE in types:
        return df.where(type_of(column).isin(*types))
    return df.where(F.col(column).isin(*types))


def type_counts(df: DataFrame, column: str = "type") -> DataFrame:
    """Rows per type, most frequent first."""
    return (
        df.groupBy(type_of(column).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "type")
    )


def filter_summary(
    df: DataFrame, types: tuple[str, ...] = DEFAULT_TYPES, column: str = "type"
) -> DataFrame:
    """One row: total, kept, filtered out and retention in percent (null for no rows)."""
    kept = F.count_if(type_of(column).isin(*types))
    return df.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept")).select(
        "total",
        "kept",
        (F.col("total") - F.col("kept")).alias("filtered_out"),
        F.round(F.try_divide(F.col("kept") * 100, "total"), 6).alias("retention"),
    )


def dedupe_status(
    df: DataFrame, key: str, order_by: list[str], is_wrong: Column, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Each row with ``status``: kept, filtered or duplicate.

    Read in order, the rows of a key up to its first acceptable row are judged by
    ``is_wrong``; that row is kept and every later one, wrong or not, is a
    duplicate.  A null key is one ordinary key.  ``order_by`` must be unique.

    The first acceptable position is a minimum per key (merged on the map side),
    joined back to the rows.  No window gathers a key's rows in one task; the
    rows of hot keys are spread.
    """
    order = F.struct(*order_by)
    rows, firsts = _firsts(df, key, order, is_wrong)
    judged = lookup_skewed(rows, firsts, "_key", "_first", "_n", order_by, slice_rows)
    status = (
        F.when(order > F.col("_first"), F.lit("duplicate"))
        .when(F.col("_wrong"), F.lit("filtered"))
        .otherwise(F.lit("kept"))
    )
    return judged.withColumn("status", status).select(*df.columns, "status")


def _firsts(df: DataFrame, key: str, order: Column, is_wrong: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with their key and verdict, and each key with its first acceptable position and size."""
    present = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("value"))
    rows = df.withColumn("_wrong", F.coalesce(is_wrong, F.lit(False))).withColumn("_key", present)
    first = F.min(F.when(~F.col("_wrong"), order)).alias("_first")
    return rows, rows.groupBy("_key").agg(first, F.count(F.lit(1)).alias("_n"))


def dedupe(df: DataFrame, key: str, order_by: list[str], is_wrong: Column) -> DataFrame:
    """The kept rows only: the first acceptable row of each key.

    Wrong rows are dropped before the shuffle, and the join back runs on key and
    position together, so even one huge key is spread evenly.
    """
    good = df.where(~F.coalesce(is_wrong, F.lit(False)))
    named = {f"_at_{c}": F.col(f"_at.{c}") for c in order_by}
    firsts = (
        good.groupBy(F.col(key).alias("_first_key"))
        .agg(F.min(F.struct(*order_by)).alias("_at"))
        .withColumns(named)
        .drop("_at")
    )
    same = F.col(key).eqNullSafe(F.col("_first_key"))
    for c in order_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return good.join(firsts, same, "left_semi")


def dedupe_summary(df: DataFrame, key: str, order_by: list[str], is_wrong: Column) -> DataFrame:
    """One row: total, kept, filtered and duplicates.

    Every key with a first acceptable row keeps one; only wrong rows are looked up, to
    tell those before it from those behind.
    """
    order = F.struct(*order_by)
    rows, firsts = _firsts(df, key, order, is_wrong)
    wrong = lookup_skewed(rows.where("_wrong"), firsts, "_key", "_first", "_n", order_by)
    behind = F.coalesce(order > F.col("_first"), F.lit(False))
    filtered = wrong.agg(F.count_if(~behind)).scalar()
    counts = firsts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("_first").alias("kept"))
    return counts.withColumn("filtered", filtered).withColumn("duplicates", F.col("total") - F.col("kept") - F.col("filtered"))
