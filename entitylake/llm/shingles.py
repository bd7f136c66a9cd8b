"""Groups of documents by the exact Jaccard similarity of their word shingles.

A text is its set of shingles, as 64-bit hashes.  Copies of a set are told by 128 bits and
one of them, the node, stands for all.

First the SimHash fingerprints of the sets are joined within ``RADIUS`` bits, by the tries of
``simhash``, and each pair found is compared in full.  These are the closest copies.  A sketch
of each node (the least of its hashes under several permutations) brings further likely
partners together; each node is compared with at most ``PARENTS`` of those before it.  Groups
of near copies are connected then, with comparisons in proportion to their size.

What is left are links between groups, and they are found without fail: two sets of at least the
threshold's similarity share a hash of their prefixes, whatever common order the hashes
have.  Rare hashes come first and those of many texts last, so that a passage of many
documents is in a prefix only where a document has little else.  Three hashes in ten are
counted in all texts.  Most texts fill their prefix with those of them that no other text has,
and meet nothing; the other hashes are counted in the texts that do not, as only these use them.
Only hashes of several groups are dealt.  Neighbours among the texts of a hash are compared first,
and of the groups that are left then all pairs, whose shared hashes are counted before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, group_bounds, in_key_blocks, lean, map_batches, ragged, whole_groups, widened
from entitylake.llm.components import components
from entitylake.llm.lines import has, overlap
from entitylake.llm.simhash import fingerprint_of, near_links, shingle_hashes
from entitylake.sources.stage import staged

#: Rows of a prefix hash, beyond which its rows are sliced and the slices meet pairwise.
SLICE_ROWS = 16_384
#: Pairs of rows compared at a time.
PAIRS = 500_000
#: Longs of parities of a set.
PARITIES = 4
BITS = [f"p{k}" for k in range(PARITIES)]
#: Bits by which fingerprints of a first pair may differ; sets of the least similarity differ in more (see README).
RADIUS = 4
#: Least hashes of a sketch, and the odd factors that permute the hashes for them.
SKETCH = 8
MINS = [f"m{k}" for k in range(SKETCH)]
FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) for k in range(SKETCH)]
#: Nodes of its sketch that a node is compared with at most; links beyond these are found by prefixes.
PARENTS = 2
#: Hashes below this one, three in ten, are counted in all texts; the others in texts that need them for their prefix.
COUNTED = np.uint64(3 * (1 << 64) // 10)
#: A hash has as many levels as it is in more texts than these; a prefix takes the hashes of low levels first.
LEVELS = (1, 2, 4, 8, 16, 64, 256, 1_024)
#: Rows of a prefix hash up to which all its pairs are compared at once; of more rows, neighbours are first.
FEW = 8
#: Bits of a map per entry, and the most bits of a map (32 MB); a fuller one lets more rows through, never fewer.
MAP_SHARE = 8
LARGEST_MAP = 28


def parities(h: np.ndarray) -> list[int]:
    """How often each of the cells occurs, modulo two: where two sets differ in a cell, some hash is in one only."""
    cells = np.bincount(((h >> np.uint64(20)) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8").tolist()


def sketches(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` without its text, with ``_hi``, ``_lo`` (a hash of the set), ``_n``, ``fp`` (its fingerprint), parities and least hashes."""
    import xxhash

    names = ["_hi", "_lo", "fp", *BITS, *MINS]

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, counts = [], []
        for t in column(batch, text):
            h = np.unique(shingle_hashes(t, size))
            whole = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
            least = [int((h * f).min().view(np.int64)) if len(h) else 0 for f in FACTORS]
            print_ = int(np.uint64(fingerprint_of(h)).view(np.int64))
            rows.append([*whole, print_, *parities(h), *least])
            counts.append(len(h))
        out = batch.drop_columns([text]).append_column("_n", pa.array(counts, pa.int32()))
        for name, values in zip(names, zip(*rows, strict=True), strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return map_batches(docs, add, widened(docs.drop(text), _n="int", **dict.fromkeys(names, "long")))


def bit_map(cells: DataFrame) -> np.ndarray:
    """A bit for each hash ``cell``, by its lowest bits; of ``MAP_SHARE`` bits per row, up to a fixed size."""
    rows = cells.count()
    bits = min(LARGEST_MAP, max(16, int(rows * MAP_SHARE).bit_length()))
    # Spark counts the positions of its bitmaps from one
    at = F.pmod("cell", F.lit(1 << bits)) + 1
    parts = cells.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        whole[start : start + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return whole


def marks(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes, as signed or unsigned longs, the map has."""
    return has(bits, h.view(np.int64) & (8 * len(bits) - 1))


def row_hash(row: str) -> Column:
    return F.xxhash64(row)


def prefix_length(n, similarity: float):
    """Hashes of a set of ``n`` in its prefix, for numbers and arrays alike."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def level_maps(hashes: DataFrame) -> list[np.ndarray]:
    """A map for each level of the hashes ``cell``, a row for each text that has it."""
    counts = staged(hashes.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > LEVELS[0]))
    return [bit_map(counts.where(F.col("rows") > least).select("cell")) for least in LEVELS]


def levels(maps: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """The level of each hash: zero where no other text has it."""
    level = np.zeros(len(h), np.int64)
    open_ = np.arange(len(h))
    for k, bits in enumerate(maps):
        open_ = open_[marks(bits, h[open_])]
        level[open_] = k + 1
    return level


def hash_sets(sent, batch: pa.RecordBatch, row: str, text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``row`` and its set in ascending order, of the rows that the broadcast map has."""
    batch = batch.filter(pa.array(marks(sent.value, batch.column(batch.schema.get_field_index("_hash")).to_numpy())))
    for i, t in zip(column(batch, row), column(batch, text), strict=True):
        if len(h := np.unique(shingle_hashes(t, size))):
            yield i, h


def prefixes(docs: DataFrame, nodes: DataFrame, row: str, text: str, size: int, similarity: float) -> DataFrame:
    """``node, keys``: the prefix of each set without hashes that no other text has, where any are left.

    The order is that of level, then hash.  The two kinds of hashes have maps of their own, so
    that a text whose prefix is full of counted ones is the same text in both passes.
    """
    context = docs.sparkSession.sparkContext
    own = context.broadcast(bit_map(nodes.select(row_hash("node").alias("cell"))))
    rows = docs.select(row, text, row_hash(row).alias("_hash"))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [h[h < COUNTED] for _, h in hash_sets(own, batch, row, text, size)]
        return pa.RecordBatch.from_pydict({"cell": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})

    first = context.broadcast(level_maps(map_batches(rows, counted, "cell long")))

    def open_prefix(h: np.ndarray, low: int) -> bool:
        alone = low - np.count_nonzero(marks(first.value[0], h[:low]))
        return alone < prefix_length(np.int64(len(h)), similarity)

    def uncounted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, h in hash_sets(own, batch, row, text, size):
            low = int(np.searchsorted(h, COUNTED))
            if open_prefix(h, low):
                found.append(h[low:])
        return pa.RecordBatch.from_pydict({"cell": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})

    second = context.broadcast(level_maps(map_batches(rows, uncounted, "cell long")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for i, h in hash_sets(own, batch, row, text, size):
            low = int(np.searchsorted(h, COUNTED))
            if not open_prefix(h, low):
                continue
            level = np.append(levels(first.value, h[:low]), levels(second.value, h[low:]))
            begin = np.argsort(level, kind="stable")[: prefix_length(np.int64(len(h)), similarity)]
            begin = begin[level[begin] > 0]
            if len(begin):
                ids.append(i)
                keys.append(h[begin].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    return map_batches(rows, run, "node long, keys array<long>")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: nodes that connect all whose fingerprints differ in ``radius`` bits at most.

    As in ``simhash.near_duplicates``: nodes of one fingerprint meet its least node, and
    these meet each other in tries.  At most a row per node and trie.
    """
    filled = nodes.where("n > 0")
    classes = staged(filled.groupBy("fp").agg(F.min("node").alias("id")))
    same = filled.join(classes, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    return same.union(near_links(classes, radius))


def likely(nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: for each node ``a`` up to ``PARENTS`` nodes before it that share a least hash and may be similar.

    Ranges of (hash, size) are partitions, so a hash of any number of nodes is spread; nodes
    on both sides of a range's end are not brought together here.
    """
    needed = ["key", "id", "n", *BITS]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, n, *bits = (batch.column(c).to_numpy() for c in needed)
            if held is not None:
                key, ids, n, *bits = (np.append(x, y) for x, y in zip(held, (key, ids, n, *bits), strict=True))
            held = [x[-1:] for x in (key, ids, n, *bits)]
            total = n[1:].astype(np.int64) + n[:-1]
            differ = sum(np.bitwise_count((x[1:] ^ x[:-1]).view(np.uint64)).astype(np.int64) for x in bits)
            near = np.minimum((total - differ) // 2, np.minimum(n[1:], n[:-1])) >= overlap(similarity, total)
            near &= (key[1:] == key[:-1]) & (ids[1:] != ids[:-1])
            yield pa.RecordBatch.from_pydict({"a": ids[1:][near], "b": ids[:-1][near], "differ": differ[near]})

    least = F.explode(F.array(*MINS)).alias("key")
    rows = nodes.where("n > 0").select(least, F.col("node").alias("id"), "n", *BITS)
    rows = rows.repartitionByRange("key", "n", "id").sortWithinPartitions("key", "n", "id")
    met = rows.mapInArrow(lean(join), "a long, b long, differ long").groupBy("a", "b").agg(F.count("*").alias("times"), F.min("differ").alias("differ"))
    # one row per node and least hash, at most: the list of a node is bounded
    best = met.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("t"), "differ", "b"))).alias("found"))
    return best.select("a", F.explode(F.slice("found", 1, PARENTS)).alias("f")).select("a", "f.b")


def shared_hashes(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many prefix hashes sets of these sizes share at least if they are similar.

    Of the prefix that ends first, hashes in both sets are in both prefixes: so many have to be
    shared there as the overlap needs beyond the rest of a set.
    """
    n, m = n.astype(np.int64), m.astype(np.int64)
    behind = np.maximum(n - prefix_length(n, similarity), m - prefix_length(m, similarity))
    return overlap(similarity, n + m).astype(np.int64) - behind


def side_by_side(dealt: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: nodes of different labels that are next to each other, by size, in a prefix hash of many.

    Fewer than there are rows.  Ranges of (hash, size) are partitions, as in ``likely``.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "id", "n", "label")]
            key, ids, n, label = rows if held is None else (np.append(x, y) for x, y in zip(held, rows, strict=True))
            held = [x[-1:] for x in (key, ids, n, label)]
            total = n[1:].astype(np.int64) + n[:-1]
            near = (key[1:] == key[:-1]) & (label[1:] != label[:-1]) & (np.minimum(n[1:], n[:-1]) >= overlap(similarity, total))
            a, b = ids[1:][near], ids[:-1][near]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    many = staged(dealt.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > FEW).select("key"))
    rows = dealt.select("key", "id", "n", "label").join(many, "key", "left_semi")
    rows = rows.repartitionByRange("key", "n", "id").sortWithinPartitions("key", "n", "id")
    return rows.mapInArrow(lean(join), "a long, b long").distinct()


def between_groups(dealt: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: nodes of different labels that share as many prefix hashes as their similarity needs.

    ``dealt`` has ``key, id, n, label``.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            bounds = group_bounds(table, ["key", "block"])
            ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
            n = n.astype(np.int64)
            # a row meets those behind its label's in its group
            ends = group_bounds(table, ["key", "block", "label"])[1:]
            after = np.repeat(ends, np.diff(ends, prepend=0))
            behind = np.repeat(bounds[1:], np.diff(bounds)) - after
            upto = np.cumsum(behind)
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
                a = np.repeat(np.arange(at, end), behind[at:end])
                b = ragged(after[at:end], behind[at:end])
                at = end
                total = n[a] + n[b]
                near = np.minimum(n[a], n[b]) >= overlap(similarity, total)
                a, b = a[near], b[near]
                need = shared_hashes(n[a], n[b], similarity)
                a, b = ids[a], ids[b]
                pairs, count = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), need], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1], "need": pairs[:, 2], "shared": count.astype(np.int64)})

    rows = in_key_blocks(dealt, "key", SLICE_ROWS).sortWithinPartitions("key", "block", "label").select("key", "block", "id", "n", "label")
    met = rows.mapInArrow(lean(join), "a long, b long, need long, shared long")
    return met.groupBy("a", "b", "need").agg(F.sum("shared").alias("shared")).where("shared >= need").select("a", "b")


def similar(docs: DataFrame, pairs: DataFrame, row: str, text: str, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose whole sets are similar enough; sets are made anew for rows in pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(ends.select(row_hash("node").alias("cell"))))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(marks(sent.value, batch.column(2).to_numpy())))
        found = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column(2), batch.column(3)
        keep = []
        for k in range(batch.num_rows):
            a, b = x[k].values.to_numpy(), y[k].values.to_numpy()
            keep.append(len(np.intersect1d(a, b, assume_unique=True)) >= overlap(similarity, len(a) + len(b)))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = staged(map_batches(docs.select(row, text, row_hash(row)), pick, "node long, shingles array<long>"))
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return staged(map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long"))


def similar_groups(docs: DataFrame, *, row: str | None = None, text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without its text, with ``component``: equal for all rows that similar ones connect.

    Words are those of ``simhash.fingerprints``; a text of fewer words than a shingle is
    one shingle, null and blank texts are the same empty set.  All pairs of a Jaccard
    similarity of at least ``similarity`` are linked.  ``row`` names a column of different longs,
    the same in every scan of ``docs``; without one, ``docs`` is written with its rows numbered.
    Every row is returned.  Columns ``_hi``, ``_lo``, ``_n``, ``fp`` and ``component`` of ``docs`` may not exist.
    """
    kept = [c for c in docs.columns if c != text]
    if row is None:
        row = "_number"
        docs = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    scanned = staged(sketches(docs, text, size))
    nodes = scanned.groupBy("_hi", "_lo").agg(F.min(row).alias("node"), *(F.first(c).alias(c.strip("_")) for c in ("_n", "fp", *BITS, *MINS)))
    nodes = staged(nodes)
    first = fingerprint_links(nodes).union(likely(nodes, similarity))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = similar(docs, staged(first), row, text, size, similarity)
    found = components(links)
    keys = staged(prefixes(docs, nodes, row, text, size, similarity))

    def dealt() -> DataFrame:
        label = nodes.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("label"))
        rows = staged(keys.join(label, "node").select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n", "label"))
        several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        sent = docs.sparkSession.sparkContext.broadcast(bit_map(several.select(F.col("key").alias("cell"))))
        return map_batches(rows, lambda batch: batch.filter(pa.array(marks(sent.value, batch.column(0).to_numpy()))), rows.schema)

    # the first connects most of what is left, so that the second, which finds all of it, has few pairs
    for search in (side_by_side, between_groups):
        open_ = staged(search(dealt(), similarity))
        if not open_.isEmpty() and not (more := similar(docs, open_, row, text, size, similarity)).isEmpty():
            links = links.union(more)
            found = components(links)
    members = nodes.select("_hi", "_lo", "node").join(found, "node", "left")
    members = members.select("_hi", "_lo", F.coalesce("component", "node").alias("component"))
    return scanned.join(members, ["_hi", "_lo"]).select(*kept, "component")
