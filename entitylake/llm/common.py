"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """A value that stays with the Python worker process from task to task, until another is asked for."""
    import sys
    import types

    held = sys.modules.setdefault("_entitylake_worker", types.ModuleType("_entitylake_worker"))
    if getattr(held, "name", None) != name:
        held.value = None
        held.value = make()
        held.name = name
    return held.value


def forget_others(state: str = "") -> None:
    """Drop what the worker process holds from tasks of another kind, unless it is this one."""
    import sys

    held = sys.modules.get("_entitylake_worker")
    if getattr(held, "name", None) not in (None, state):
        held.name = held.value = None
        give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Words whose hashes a worker keeps.
HASHES_KEPT = 200_000


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < HASHES_KEPT:
            self[word] = h
        return h


def file_bytes(path: str) -> bytes:
    """A vocabulary file of fixed size, read on the driver and sent to the executors."""
    return Path(path).read_bytes()


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving back what the worker process has freed when a task ends.

    Python workers are kept for later tasks; without this each keeps the most memory
    that any of its tasks had.
    """

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return whole


#: Texts whose Python values and results a worker holds at once.
TEXTS_AT_ONCE = 500


def cut_to(batch: pa.RecordBatch, rows: int) -> Batches:
    """The batch in slices of at most so many rows."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, *, rows: int | None = None, state: str = "") -> DataFrame:
    """``fn`` applied to each Arrow batch; rows stay where they are.

    With ``rows``, for an ``fn`` that takes each row alone, batches are cut to so many
    rows.  ``state`` names the ``worker_state`` that ``fn`` asks for; any other that the
    worker process holds is dropped before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(state)
        for batch in batches:
            if batch.num_rows:
                yield from map(fn, cut_to(batch, rows or batch.num_rows))

    return df.mapInArrow(lean(run), schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def widened(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` with further fields; ``df`` keeps its own."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return schema


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total, dtype=np.int64) - before + np.repeat(starts, lengths)


def in_key_blocks(df: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Rows dealt into blocks within which all rows of a key that have to meet do meet.

    A key of up to ``block_rows`` rows is one block.  A larger one is cut into slices by
    a hash of the row's ``id`` and each pair of slices is a block, so that no block has
    more than about twice ``block_rows`` rows, whatever share of the data the key has.
    Keys of one row are left out, as nothing can meet there.  Adds ``block`` (of the two
    slices) and returns the rows partitioned and sorted by key and block.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_rows")).where("_rows > 1")
    slices = F.ceil(F.col("_rows") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(key)), F.col("_slices")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_slices") - 1),
        lambda other: (F.least(other, F.col("_own")) * F.col("_slices") + F.greatest(other, F.col("_own"))).cast("int"),
    )
    met = df.join(sizes.select(key, slices.alias("_slices")), key).withColumn("_own", own)
    met = met.withColumn("block", F.explode(pairs)).drop("_own", "_slices")
    return met.repartition(key, "block").sortWithinPartitions(key, "block")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of many whole groups each, from batches sorted by ``by``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        last = {c: table.column(c)[-1].as_py() for c in by}
        same = np.ones(table.num_rows, bool)
        for c in by:
            same &= table.column(c).to_numpy() == last[c]
        cut = table.num_rows - int(same.sum())
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for c in by:
        values = table.column(c).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), n)
