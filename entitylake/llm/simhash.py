"""SimHash fingerprints of word shingles and their self-join within a few bits.

The join walks binary tries of the fingerprints.  64 bits are cut into blocks; two
fingerprints within the radius agree on some pair of blocks, so a trie is built for each
pair, with the bits of these two blocks first: there both sides follow one path.  Below,
node pairs are traversed together, differing bits add up and a pair beyond the budget is
dropped.  A trie is a sorted array and a node a range of it, so all node pairs of many
tries go down a level in a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, group_bounds, in_key_blocks, lean, map_batches, whole_groups, widened
from entitylake.llm.components import components, roots
from entitylake.sources.stage import staged

SEED = 42
#: Fingerprints of one trie, beyond which it is cut into slices that are joined pairwise.
TRIE_ROWS = 4_096
#: A pair of nodes with at most so many fingerprint pairs is compared at once.
LEAF_PAIRS = 16
#: Node or fingerprint pairs held at a time.
FRONTIER = 500_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a text of fewer words is one, one without words none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - size + 1)


def fingerprint(text: str | None, size: int) -> int:
    """SimHash of a text: a bit is set where more than half of the shingles' hashes have it."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", size: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint of the whole text as a long (its 64 bits).

    Words are runs of characters that are no ASCII white space, with A-Z in lower case; a
    text of fewer words than a shingle is one shingle, a null or empty one has zero.
    """

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in column(batch, text)], np.uint64)
        return batch.drop_columns([text]).append_column(name, pa.array(found.view(np.int64)))

    return map_batches(docs, add, widened(docs.drop(text), **{name: "long"}))


def block_pairs(radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Blocks of bits (from, to) and the pairs of them, for ``radius`` differing bits.

    With two blocks more than the radius at least two of them hold no differing bit.
    """
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = list(zip(edges, edges[1:], strict=False))
    return blocks, list(combinations(range(len(blocks)), 2))


def trie_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint and pair of blocks the trie: the pair's number and the blocks' bits."""
    blocks, pairs = block_pairs(radius)
    keys = []
    for number, (i, j) in enumerate(pairs):
        (a, b), (c, d) = blocks[i], blocks[j]
        low = (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        high = (fp >> np.uint64(c)) & np.uint64((1 << (d - c)) - 1)
        keys.append((np.uint64(number) << np.uint64(56)) | (high << np.uint64(b - a)) | low)
    return np.stack(keys, 1)


def walk(fp: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints of one group that differ in ``radius`` bits at most.

    ``fp`` is sorted within each group; the groups begin at ``bounds``.  The frontier has
    pairs of nodes at one depth: ranges [a0, a1) and [b0, b1) and the bits by which their
    paths differ; a node is paired with itself first.
    """
    starts, ends = bounds[:-1], bounds[1:]
    many = ends - starts > 1
    stack = [(64, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        bits, a0, a1, b0, b1, differ = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER // 8:
            half = len(a0) // 2
            stack += [(bits, *(x[:half] for x in (a0, a1, b0, b1, differ))), (bits, *(x[half:] for x in (a0, a1, b0, b1, differ)))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (bits == 0)
        yield from compared(fp, *(x[small] for x in (a0, a1, b0, b1)), radius)
        if bits == 0:
            continue
        a0, a1, b0, b1, differ = (x[~small] for x in (a0, a1, b0, b1, differ))
        bit = bits - 1
        ma, mb = split(fp, a0, a1, bit), split(fp, b0, b1, bit)
        same = a0 == b0
        children = [
            (a0, ma, b0, mb, differ),
            (ma, a1, mb, b1, differ),
            (a0, ma, mb, b1, differ + 1),
            (ma[~same], a1[~same], b0[~same], mb[~same], differ[~same] + 1),
        ]
        parts = [np.concatenate(x) for x in zip(*children, strict=True)]
        alone = (parts[0] == parts[2]) & (parts[1] - parts[0] < 2)
        keep = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= radius) & ~alone
        stack.append((bit, *(x[keep] for x in parts)))


def split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in sorted ranges with equal higher bits ``bit`` turns to one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (fp[mid[open_]] >> np.uint64(bit)) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def compared(fp, a0, a1, b0, b1, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The fingerprint pairs of node pairs, checked in full."""
    counts = (a1 - a0) * (b1 - b0)
    upto = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + FRONTIER)))
        n, width = counts[begin:end], (b1 - b0)[begin:end]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(a0[begin:end], n) + k // np.repeat(width, n)
        j = np.repeat(b0[begin:end], n) + k % np.repeat(width, n)
        near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        yield i[near], j[near]
        begin = end


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between classes (``id``, ``fp``) that connect all that are within ``radius`` bits.

    A trie yields a spanning forest of its links, not each of them.
    """

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(1).to_numpy().view(np.uint64)
        keys = trie_keys(fp, radius)
        n = keys.shape[1]
        ids, fps = (np.repeat(batch.column(c).to_numpy(), n) for c in (0, 1))
        return pa.RecordBatch.from_pydict({"id": ids, "fp": fps, "key": keys.ravel().view(np.int64)})

    tries = map_batches(classes.select("id", "fp"), keyed, "id long, fp long, key long")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            bounds = group_bounds(table, ["key", "block"])
            fp, ids = table.column("fp").to_numpy().view(np.uint64), table.column("id").to_numpy()
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.lexsort((fp, group))
            fp, ids = fp[order], ids[order]
            node = least = np.empty(0, np.int64)
            for i, j in walk(fp, bounds, radius):
                if len(i):
                    node, least = roots(np.concatenate([node, ids[i]]), np.concatenate([least, ids[j]]))
            keep = node != least
            yield pa.RecordBatch.from_pydict({"a": node[keep], "b": least[keep]})

    return in_key_blocks(tries, "key", TRIE_ROWS).select("id", "fp", "key", "block").mapInArrow(lean(join), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """``id_col, fp, component_id`` for every row: the least id reachable by near fingerprints.

    Fingerprints (see ``fingerprints``) link where they differ in at most ``radius`` bits;
    copies meet as one class, the least id of a fingerprint.  Rows repeated under one id
    are returned as often.  A row without an id belongs to the component of its
    fingerprint but cannot name one, so it has a null component where no row with an id
    is near.  Other columns are not used; an empty table gives no rows.
    """
    known = staged(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), size=size))
    classes = known.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"))
    found = components(near_links(classes, radius))
    named = classes.join(found, classes["id"] == found["node"], "left")
    # written first: Spark then knows its size, and can split the rows of a fingerprint that many share
    named = staged(named.select("fp", F.coalesce("component", "id").alias("component_id")))
    return known.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")
