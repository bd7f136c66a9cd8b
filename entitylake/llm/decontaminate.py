"""Benchmark decontamination: passages of benchmark items in documents.

A benchmark item and each window of its size in a document are sets of weighted word
shingles.  Only windows in which known shingles have enough weight can be similar; these
get a weighted SimHash fingerprint.  Fingerprints within the radius agree on one of
radius + 1 blocks of bits, so a lookup per block finds all of them; the weighted Jaccard
similarity of the shingles decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import TEXTS_AT_ONCE, Hashes, column, lean, map_batches, widened, worker_state

#: Words of a shingle, the least similarity, and the differing bits within which
#: fingerprints are looked up: at a similarity of 0.8 about 10 of 64 bits are expected to
#: differ, with a deviation of 3.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 20
#: Items that are looked for in one pass over the documents; more items take more passes.
BLOCK_ITEMS = 20_000
MATCHES = "array<struct<item_id:{0},similarity:double,start_word:int,n_words:int>>"

WORD = re.compile(r"\w+")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def words(text: str | None, hashes: Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, WORD.findall((text or "").lower())), np.uint64)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    out = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(out)])
    return out


def simhash(shingle: np.ndarray, weight: np.ndarray) -> int:
    bits = np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return int(np.packbits(weight @ (2 * bits - 1) > 0, bitorder="little").view("<u8")[0])


def blocks(fingerprint: int, radius: int) -> list[tuple[int, int]]:
    edges = [i * 64 // (radius + 1) for i in range(radius + 2)]
    return [(k, fingerprint >> a & ((1 << (b - a)) - 1)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


@dataclass
class Index:
    """A block of benchmark items: their shingles with weights, and fingerprints by size and block."""

    ids: list
    sizes: list[int]
    shingle_sets: list[dict[int, int]]
    prints: list[int]
    known: np.ndarray
    weights: np.ndarray
    unknown_weight: float
    sizes_of: list[tuple[int, ...]]
    lookup: dict[tuple[int, int, int], list[int]]
    widths: list[int]
    seen: np.ndarray
    similarity: float
    radius: int
    common: np.ndarray
    common_weights: np.ndarray

    def weight(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each shingle and its place among the known ones, or -1."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        other = np.full(len(h), self.unknown_weight)
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            other = np.where(self.common[place] == h, self.common_weights[place], other)
        return np.where(hit, self.weights[at], other), np.where(hit, at, -1)

    def matches(self, text: str | None, hashes: Hashes) -> list[dict]:
        """The best window of the text for each item that it contains."""
        found: dict[int, dict] = {}
        w = words(text, hashes)
        for width in self.widths:
            h = shingles(w, width)
            hits = np.flatnonzero(self.seen[(h & np.uint64(len(self.seen) - 1)).astype(np.int64)])
            if not len(hits):
                continue
            weight, at = self.weight(h)
            sizes = {s for k in np.unique(at[hits]).tolist() if k >= 0 for s in self.sizes_of[k] if min(WORDS, s) == width}
            total = np.concatenate([[0.0], np.cumsum(weight)])
            shared = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, weight, 0.0))])
            for size in sizes:
                n = min(size - width + 1, len(h))  # a shorter text is one window
                whole, hit = total[n:] - total[:-n], shared[n:] - shared[:-n]
                for start in np.flatnonzero(hit >= self.similarity * whole - 1e-9).tolist():
                    self.compare(h[start : start + n], weight[start : start + n], size, start, found)
        return sorted(found.values(), key=lambda m: m["item"])

    def compare(self, window: np.ndarray, weight: np.ndarray, size: int, start: int, found: dict[int, dict]) -> None:
        fingerprint = simhash(np.ascontiguousarray(window), weight)
        near = {i for k, value in blocks(fingerprint, self.radius) for i in self.lookup.get((size, k, value), ())}
        near = {i for i in near if (self.prints[i] ^ fingerprint).bit_count() <= self.radius}
        if not near:
            return
        counts: dict[int, int] = {}
        for s in window.tolist():
            counts[s] = counts.get(s, 0) + 1
        cost = dict(zip(window.tolist(), weight.tolist(), strict=True))
        for i in near:
            item = self.shingle_sets[i]
            both = sum(min(c, item.get(s, 0)) * cost[s] for s, c in counts.items())
            value = both / (sum(c * cost[s] for s, c in counts.items()) + self.mass[i] - both)
            if value >= self.similarity - 1e-9 and (i not in found or value > found[i]["similarity"]):
                found[i] = {"item": i, "similarity": min(1.0, value), "start_word": start, "n_words": size}

    def __post_init__(self) -> None:
        known = {int(s): float(v) for s, v in zip(self.known, self.weights, strict=True)}
        self.mass = [sum(c * known[s] for s, c in item.items()) for item in self.shingle_sets]


def index(items: list[tuple], similarity: float, radius: int, total: int, common: np.ndarray, counts: np.ndarray) -> Index:
    """Items (id, text) with words, as an index.

    Weights are those of all ``total`` items: shingles of several items come sorted, with
    their ``counts``; any other is in one item.
    """
    hashes = Hashes()
    kept = [(i, w) for i, text in items if len(w := words(text, hashes))]
    prepared = [(i, len(w), shingles(w, min(WORDS, len(w)))) for i, w in kept]
    known = np.unique(np.concatenate([h for _, _, h in prepared])) if prepared else np.zeros(0, np.uint64)
    df = np.ones(len(known))
    _, at, place = np.intersect1d(known, common, assume_unique=True, return_indices=True)
    df[at] = counts[place]
    weights = np.log1p(total / df)
    sizes_of: dict[int, set[int]] = {}
    lookup: dict[tuple[int, int, int], list[int]] = {}
    prints, sets = [], []
    for number, (_, size, h) in enumerate(prepared):
        own = weights[np.searchsorted(known, h)]
        prints.append(simhash(h, own))
        unique, count = np.unique(h, return_counts=True)
        sets.append(dict(zip(unique.tolist(), count.tolist(), strict=True)))
        for s in unique.tolist():
            sizes_of.setdefault(s, set()).add(size)
        for k, value in blocks(prints[-1], radius):
            lookup.setdefault((size, k, value), []).append(number)
    seen = np.zeros(1 << max(16, (8 * len(known)).bit_length()), bool)
    seen[(known & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    return Index(
        [i for i, _, _ in prepared], [s for _, s, _ in prepared], sets, prints, known, weights, float(np.log1p(max(1, total))),
        [tuple(sorted(sizes_of[s])) for s in known.tolist()], lookup, sorted({min(WORDS, s) for _, s, _ in prepared}), seen, similarity, radius, common, np.log1p(total / counts),
    )


def usable(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(item_id, item_text).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct()


def shared_shingles(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and the shingles of several items with how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            own = [w for t in column(batch, item_text) if len(w := words(t, hashes))]
            found = [np.unique(shingles(w, min(WORDS, len(w)))) for w in own]
            h = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            # a row without a shingle for each item counts the items
            h = pa.concat_arrays([pa.array(h, pa.int64()), pa.nulls(len(own), pa.int64())])
            yield pa.RecordBatch.from_arrays([h], names=["h"])

    rows = usable(benchmark, item_id, item_text).mapInArrow(lean(run), "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = rows.where("h is null or n > 1").toArrow()
    h, n = found.column("h"), found.column("n").to_numpy()
    null = h.is_null().to_numpy()
    common = h.fill_null(0).to_numpy()[~null].view(np.uint64)
    order = np.argsort(common)
    return int(n[null].sum()), common[order], n[~null][order]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, size: int) -> Iterator[list[tuple]]:
    """Items in blocks of ``size``: the driver holds one at a time."""
    block: list[tuple] = []
    for row in usable(benchmark, item_id, item_text).orderBy(item_id, item_text).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``docs`` with ``matches``: the items that the whole text contains, with their best window.

    A window has as many words (runs of word characters in lower case) as the item and
    matches where the weighted Jaccard similarity of their shingles is at least
    ``similarity``; a shingle weighs ln(1 + items / items with it), over all items.  An item or text of
    fewer words than a shingle is one shingle, one without words matches nothing.  Items
    come in blocks that are broadcast, ``block_items`` at a time.  Null texts match
    nothing; all rows and columns stay, a column ``matches`` is replaced.
    """
    docs = docs.drop("matches")
    id_type = benchmark.schema[item_id].dataType.simpleString()
    context, columns = docs.sparkSession.sparkContext, list(docs.columns)
    found = docs
    names = []
    weighed = context.broadcast(shared_shingles(benchmark, item_id, item_text))
    for number, items in enumerate(item_blocks(benchmark, item_id, item_text, block_items)):
        sent = context.broadcast(items)
        names.append(f"_matches_{number}")
        key = f"items_{context.applicationId}_{sent._jbroadcast.id()}"

        def search(batch: pa.RecordBatch, sent=sent, name=names[-1], key=key) -> pa.RecordBatch:
            items, hashes = worker_state(key, lambda: (index(sent.value, similarity, radius, *weighed.value), Hashes()))
            found = []
            for value in column(batch, text):
                own = items.matches(value, hashes) if len(items.known) else []
                found.append([{"item_id": items.ids[m["item"]], **{k: m[k] for k in ("similarity", "start_word", "n_words")}} for m in own])
            kind = pa.list_(pa.struct([("item_id", item_type(batch, id_type)), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())]))
            return batch.append_column(name, pa.array(found, kind))

        found = map_batches(found, search, widened(found, **{names[-1]: MATCHES.format(id_type)}), rows=TEXTS_AT_ONCE, state=key)
    empty = F.array().cast(MATCHES.format(id_type))
    return found.select(*columns, reduce(lambda a, b: F.concat(a, b), [F.col(n) for n in names], empty).alias("matches"))


def item_type(batch: pa.RecordBatch, name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """``id_col, item_id, similarity, start_word, n_words`` for each document and item found in it."""
    found = with_matches(docs.select(id_col, text), benchmark, text=text, item_id=item_id, item_text=item_text, **options)
    return found.select(id_col, F.explode("matches").alias("m")).select(id_col, F.col("m.item_id").alias(item_id), "m.similarity", "m.start_word", "m.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found."""
    return with_matches(docs, benchmark, **options).where(F.size("matches") == 0).drop("matches")
