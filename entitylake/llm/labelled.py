"""The labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most.
SAMPLE_ROWS = 20_000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, out: int) -> Column:
    return F.coalesce(fold(id_col, folds) == out, F.lit(False))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, *, id_col: str, text: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``text, label`` of labelled documents outside the fold ``out``: all, or ``rows`` of them by a hash of the id.

    The ids, ``rows`` at most, are broadcast, so no text is shuffled.  Labels that are null
    or not 0 or 1, or have no id, are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & (fold(id_col, folds) != out))
    usable = usable.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("text", "label")
