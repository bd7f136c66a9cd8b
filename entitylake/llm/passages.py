"""Substring deduplication: passages that an earlier document has are removed word by word.

1. Documents are dealt into blocks of a few megabytes.  Each window of consecutive words
   has an anchor, the short gram of least hash inside it: equal windows have equal anchors.
2. Anchors that two documents share are confirmed; each block learns which of its own are.
3. Around its confirmed anchors a block cuts out passages, the union of the windows of an
   anchor, and sends each different passage once to the shard of its anchor.
4. A shard confirms by their words the windows that several documents have, compiles them
   into Aho-Corasick automata over word numbers and streams its passages through them:
   every occurrence is located, and those in later documents go back as word ranges.
5. Each block removes the words of its ranges.

Hashes only route; words decide.  The texts are shuffled once, for all three readings of
the blocks.  An anchor that many documents have is replaced by the hashes of its windows, each
of which a block sends once, so no group grows with the occurrences of a passage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import lean, ragged, widened

WINDOW = 13
#: Words of an anchor.
GRAM = 4
#: Bytes of text of a block, on average.
BLOCK_BYTES = 2_000_000
#: Documents of an anchor from which it is split into its windows.
HOT_DOCS = 200
#: Rows of passages for which a shard compiles one automaton.
SHARD_ROWS = 20_000
#: Words that are hashed at once, and bytes.
CHUNK = 1 << 18

#: White space that separates words: blank, tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of many texts: their bytes in one buffer, each word followed by one blank.

    ``starts`` and ``lengths`` place the words in ``bytes``; ``doc`` numbers their texts.
    """

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        inside = ~space[joined]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.doc = np.searchsorted(bounds, starts, side="right")
        self.lengths = ends - starts
        # keep each word and one byte behind it, which becomes a blank
        kept = inside.copy()
        kept[ends] = True
        blank = joined.copy()
        blank[ends] = 0x20
        self.bytes = blank[kept]
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, good enough to route by."""
        if not len(self):
            return np.empty(0, np.uint64)
        letters = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
        parts = []
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.starts, self.starts[low] + CHUNK)))
            begin, end = self.starts[low], self.starts[high - 1] + self.lengths[high - 1] + 1
            starts = self.starts[low:high] - begin
            at = (np.arange(end - begin) - np.repeat(starts, self.lengths[low:high] + 1)).astype(np.uint64)
            parts.append(np.add.reduceat(mixed(letters[self.bytes[begin:end]] + at * MIX), starts))
            low = high
        return mixed(np.concatenate(parts))

    def grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` consecutive words, one for each word that so many begin at."""
        n = max(len(words) - size + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = mixed(h + words[j : j + n])
        return h

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that lie in one text (the word each begins at), the word their anchor begins at, hashes of all grams."""
        words = self.hashes()
        grams = self.grams(words, gram)
        span = window - gram + 1
        if len(words) < window:
            return np.empty(0, np.int64), np.empty(0, np.int64), grams
        views = np.lib.stride_tricks.sliding_window_view(grams, span)
        begins = np.flatnonzero(self.doc[: len(views)] == self.doc[window - 1 :])
        least = [np.argmin(views[begins[i : i + CHUNK]], axis=1) for i in range(0, len(begins), CHUNK)]
        return begins, begins + np.concatenate([np.empty(0, np.int64), *least]), grams

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` to before ``last``, one blank between them."""
        return self.bytes[self.starts[first] : self.starts[last - 1] + self.lengths[last - 1]].tobytes()


@dataclass(frozen=True)
class Named:
    """Columns of the blocks: the caller's id and text, a number per row and the block."""

    id: str
    text: str
    row: str
    block: str

    def read(self, table: pa.Table) -> tuple[pa.Table, Words]:
        """A block's rows by their number, which all readers see alike, and their words."""
        table = table.sort_by(self.row).combine_chunks()
        return table, Words([t or b"" for t in table.column(self.text).cast(pa.binary()).to_pylist()])

    def ids(self, table: pa.Table) -> pa.ChunkedArray:
        return table.column(self.id).cast(pa.int64())

    def number(self, table: pa.Table) -> int:
        return table.column(self.block)[0].as_py()


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def block_anchors(table: pa.Table, named: Named, window: int, gram: int) -> pa.Table:
    """``key, block, docs``: the different anchors of a block, and how many of its documents have them."""
    block = named.number(table)
    table, words = named.read(table)
    _, at, grams = words.anchors(window, gram)
    ids = named.ids(table)
    known = ids.is_valid().to_numpy()
    at = np.unique(at)
    at = at[known[words.doc[at]]]
    keys, docs = grams[at], ids.fill_null(0).to_numpy()[words.doc[at]]
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new_key = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    new = new_key | np.append(True, docs[1:] != docs[:-1])[: len(keys)]
    first = np.flatnonzero(new_key)
    count = np.add.reduceat(new.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return pa.table({"key": signed(keys[first]), "block": np.full(len(first), block, np.int64), "docs": count})


PASSAGES = "key long, first long, block long, passage binary, starts array<int>, docs array<long>"


def block_passages(table: pa.Table, confirmed: pa.Table, named: Named, window: int, gram: int) -> pa.Table:
    """The different passages of a block around its confirmed anchors, each with all its places."""
    found: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
    if table.num_rows and confirmed.num_rows:
        block = named.number(table)
        table, words = named.read(table)
        begins, at, grams = words.anchors(window, gram)
        ids = named.ids(table).to_pylist()
        known = np.array([i is not None for i in ids])
        ours = confirmed.column("key").to_numpy().view(np.uint64)
        hot = np.sort(ours[confirmed.column("hot").to_numpy(zero_copy_only=False)])
        near = np.isin(grams[at], ours) & known[words.doc[begins]]
        begins, at = begins[near], at[near]
        keys = grams[at]
        split = np.isin(keys, hot)
        if split.any():
            keys = keys.copy()
            keys[split] = mixed(words.grams(words.hashes(), window)[begins[split]])
        if len(begins):
            # runs of windows with the same anchor; a window of a hot one is a run of its own
            new = np.ones(len(begins), bool)
            new[1:] = (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1) | split[1:]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(begins)) - 1
            for key, a, b in zip(signed(keys[first]).tolist(), begins[first].tolist(), begins[last].tolist()):
                starts, docs = found.setdefault((key, words.text(a, b + window)), ([], []))
                starts.append(a)
                docs.append(ids[words.doc[a]])
        places = list(found.values())
        return pa.table({
            "key": pa.array([k for k, _ in found], pa.int64()),
            "first": pa.array([min(d) for _, d in places], pa.int64()),
            "block": pa.array([block] * len(found), pa.int64()),
            "passage": pa.array([t for _, t in found], pa.binary()),
            "starts": pa.array([s for s, _ in places], pa.list_(pa.int32())),
            "docs": pa.array([d for _, d in places], pa.list_(pa.int64())),
        })
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array([], k) for k in kinds], names=["key", "first", "block", "passage", "starts", "docs"])


class Shard:
    """Passages that arrive by key and first document, located by automata over word numbers.

    Only the windows of the last key are kept from one batch to the next.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.key: int | None = None
        self.firsts: dict[bytes, int] = {}  # windows of ``key`` and the first document that has them

    def windows(self, words: Sequence) -> Iterator:
        return (words[i : i + self.window] for i in range(len(words) - self.window + 1))

    def locate(self, keys: list[int], texts: list[bytes], firsts: list[int], several: list[bool]) -> list[list[tuple[int, int, int]]]:
        """For each different text, in order of appearance, spans of words (low, high) and the first document that has them.

        Rows come by key and first document, so the first row of a text or window has it first.
        """
        numbers: dict[bytes, int] = {}
        words = [tuple([numbers.setdefault(w, len(numbers)) for w in t.split(b" ")]) for t in texts]
        crowded = {k for k, n in Counter(keys).items() if n > 1} | {self.key}
        first: dict[tuple[int, ...], int] = {}
        if self.key == keys[0]:
            for window, doc in self.firsts.items():
                first[tuple([numbers.setdefault(w, len(numbers)) for w in window.split(b" ")])] = doc
        # confirm: a passage that stands alone recurs as a whole, others may share windows
        confirmed: dict[tuple[int, ...], int] = {}
        for key, passage, doc, shared in zip(keys, words, firsts, several):
            if key not in crowded:
                if shared:
                    confirmed[passage] = doc
                continue
            for window in self.windows(passage):
                earliest = first.setdefault(window, doc)
                if earliest != doc or shared:
                    confirmed[window] = earliest
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if confirmed:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for phrase, doc in confirmed.items():
                automaton.add_word(phrase, (len(phrase), doc))
            automaton.make_automaton()
            for spans, passage, key, shared in zip(found, words, keys, several):
                if not shared and key not in crowded:
                    continue
                for end, (size, doc) in automaton.iter(passage):
                    low = end - size + 1
                    if spans and spans[-1][2] == doc and low <= spans[-1][1]:
                        low = spans.pop()[0]
                    spans.append((low, end + 1, doc))
        self.carry(keys, texts, firsts)
        return found

    def carry(self, keys: list[int], texts: list[bytes], firsts: list[int]) -> None:
        if keys[-1] != self.key:
            self.key, self.firsts = keys[-1], {}
        at = len(keys) - 1
        while at > 0 and keys[at - 1] == keys[-1]:
            at -= 1
        for text, doc in zip(texts[at:], firsts[at:]):
            for window in self.windows(text.split(b" ")):
                self.firsts.setdefault(b" ".join(window), doc)


def shard_ranges(batches: Iterator[pa.RecordBatch], window: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``block, low, high``: ranges of a block's words that an earlier document has."""
    shard = Shard(window)

    def ranges(table: pa.Table) -> pa.RecordBatch:
        keys, texts, firsts = (table.column(c).to_pylist() for c in ("key", "passage", "first"))
        starts, docs = (table.column(c).combine_chunks() for c in ("starts", "docs"))
        places = np.diff(starts.offsets.to_numpy())
        # each different text is located once; ``text_of`` has its number for each row
        numbers: dict[bytes, int] = {}
        text_of = np.array([numbers.setdefault(t, len(numbers)) for t in texts])
        _, own = np.unique(text_of, return_index=True)
        several = np.bincount(text_of, places) > 1
        spans = shard.locate([keys[r] for r in own], list(numbers), [firsts[r] for r in own], several.tolist())
        flat = np.array([s for of_text in spans for s in of_text], np.int64).reshape(-1, 3)
        counts = np.array([len(of_text) for of_text in spans])
        # every place of a text meets every span of it
        row = np.repeat(np.arange(len(texts)), places)
        met = counts[text_of[row]]
        span = ragged((np.cumsum(counts) - counts)[text_of[row]], met)
        place = np.repeat(np.arange(len(row)), met)
        low, high, earliest = flat[span].T
        later = earliest < docs.flatten().to_numpy()[place]
        start = starts.flatten().to_numpy()[place]
        block = table.column("block").to_numpy()[row[place]]
        return pa.RecordBatch.from_pydict({
            "block": block[later], "low": (start + low)[later].astype(np.int32), "high": (start + high)[later].astype(np.int32)
        })

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                yield ranges(pa.Table.from_batches(held))
                held, count = [], 0
    if count:
        yield ranges(pa.Table.from_batches(held))


SPAN = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64())])


def without_ranges(table: pa.Table, ranges: pa.Table, named: Named, fields: list[str], results: list[str]) -> pa.Table:
    """A block's rows with the words of the ranges removed: ``fields``, text left, words, removed spans."""
    if not table.num_rows:
        kinds = [*(table.schema.field(f).type for f in fields), pa.string(), pa.int64(), pa.list_(SPAN)]
        return pa.table([pa.array([], k) for k in kinds], names=[*fields, *results])
    table, words = named.read(table)
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, ranges.column("low").to_numpy(), 1)
    np.add.at(change, ranges.column("high").to_numpy(), -1)
    gone = np.cumsum(change)[:n] > 0
    bounds = np.searchsorted(words.doc, np.arange(table.num_rows + 1))
    left = words.bytes[np.repeat(~gone, words.lengths + 1)]
    ends = np.append(0, np.cumsum((words.lengths + 1) * ~gone))[bounds]
    texts = [left[a : max(b - 1, a)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    # spans end where removal ends or the text does
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(gone & (~np.append(False, gone)[:n] | edge[:n]))
    end = np.flatnonzero(gone & (~np.append(gone, False)[1:] | edge[1:])) + 1
    owner = words.doc[begin]
    spans = pa.StructArray.from_arrays([pa.array(begin - bounds[owner], pa.int64()), pa.array(end - begin, pa.int64())], fields=list(SPAN))
    offsets = np.searchsorted(owner, np.arange(table.num_rows + 1))
    columns = [
        *[table.column(f) for f in fields],
        pa.array(texts, pa.binary()).cast(pa.string()),
        pa.array(np.diff(bounds), pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
    ]
    return pa.table(columns, names=[*fields, *results])


def unused(name: str, taken: list[str]) -> str:
    """``name``, or a longer one where a column has it (names differ by more than case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def blocks_of(docs: DataFrame, named: Named, block_bytes: int) -> DataFrame:
    """``docs`` with a number per row and a block, shuffled by block.

    Rows go to blocks by their number, so rows repeated any number of times are spread.
    """
    size = docs.agg(F.sum(F.octet_length(named.text))).first()[0] or 0
    blocks = size // block_bytes + 1
    rows = docs.withColumn(named.row, F.monotonically_increasing_id())
    return rows.withColumn(named.block, F.pmod(F.xxhash64(named.row), F.lit(blocks))).repartition(named.block)


def without_repeated_passages(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text: str = "text",
    kept: str = "kept",
    n_words: str = "n_words",
    removed: str = "removed",
    block_bytes: int = BLOCK_BYTES,
    hot_docs: int = HOT_DOCS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``docs`` with the words left (joined by blanks), the number of words and the removed spans of words.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a
    row with a smaller id.  Windows are those of the input.  Words are runs of bytes other
    than blank and tab to carriage return.  A null text has no words; a text shorter than a
    window loses none.  Rows without an id are neither smaller nor larger than others: they
    keep their words and take none away.  Rows repeated under one id take nothing from each
    other.  Columns of ``docs`` named like a result are replaced.  Ids are integers.  An
    empty table gives an empty result.
    """
    if not 0 < gram <= window:
        raise ValueError("an anchor has at least one word and no more than a window")
    results = [kept, n_words, removed]
    fields = [c for c in docs.columns if c not in results]
    named = Named(id_col, text, unused("_row", docs.columns), unused("_block", docs.columns))
    blocks = blocks_of(docs.select(*fields, *{id_col, text}.difference(fields)), named, block_bytes)
    # all three readings have the same columns, so that Spark shuffles the texts once
    anchors = blocks.groupBy(named.block).applyInArrow(
        lambda table: block_anchors(table, named, window, gram), "key long, block long, docs long"
    )
    key = Window.partitionBy("key")
    shared = anchors.withColumn("docs", F.sum("docs").over(key)).where("docs > 1")
    shared = shared.select("key", "block", (F.col("docs") >= hot_docs).alias("hot"))
    passages = (
        blocks.groupBy(named.block)
        .cogroup(shared.groupBy("block"))
        .applyInArrow(lambda table, confirmed: block_passages(table, confirmed, named, window, gram), PASSAGES)
    )
    ranges = (
        passages.repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(lean(lambda batches: shard_ranges(batches, window, shard_rows)), "block long, low int, high int")
    )
    spans = {kept: "string", n_words: "long", removed: "array<struct<start:long,length:long>>"}
    return (
        blocks.groupBy(named.block)
        .cogroup(ranges.groupBy("block"))
        .applyInArrow(
            lambda table, gone: without_ranges(table, gone, named, fields, results), widened(docs.select(*fields), **spans)
        )
    )
