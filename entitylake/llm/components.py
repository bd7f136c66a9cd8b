"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import lean
from entitylake.sources.stage import staged


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the least node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        # hook the roots of both ends, then follow the labels to the end
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while not np.array_equal(shorter := label[label], label):
            label = shorter
        if np.array_equal(label, before):
            return nodes, nodes[label]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes, at most one per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = np.empty(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                node, least = roots(
                    np.concatenate([node, batch.column(0).to_numpy()]),
                    np.concatenate([least, batch.column(1).to_numpy()]),
                )
        keep = node != least
        yield pa.RecordBatch.from_pydict({"a": node[keep], "b": least[keep]})

    return links.select("a", "b").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of the links (a, b): the least node it reaches.

    Stars grow in turn: each node's larger neighbours move to its least one, then each
    node's smaller ones do, until nothing moves.  Joins are on nodes; a hub is one side's
    single row and its links are the other side's, which skew handling may split.  Every
    round is written to the shared folder.  Null ends are ignored.
    """
    found = staged(contracted(links.where("a is not null and b is not null and a <> b").distinct()))
    if found.isEmpty():
        return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        both = found.select("a", "b").union(found.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
