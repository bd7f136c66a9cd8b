"""Removal of repeated lines by an exact set-similarity join.

A line is its set of words.  Words are ordered by rarity in the whole corpus; two sets of
a Jaccard similarity of at least the threshold share a word of their prefixes.  Equal
sets meet first, by a signature.  For the others, prefix words are the join key: their
postings are dealt in buckets, many to a row, and within a word the shorter set needs its
first words only and meets no set that is too long.  Position in the prefix and a bitmap
of parities bound the overlap before words are compared.  A line needs only one earlier match to go, so each line is verified
against its few most promising earlier lines; only where these fail are all others tried.

Words are runs of bytes other than ASCII white space, with A-Z in lower case.  They are
hashed by one pass of array operations over the bytes of many texts; what is removed is
decided on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import TEXTS_AT_ONCE, column, cut_to, group_bounds, lean, ragged, whole_groups, widened, worker_state
from entitylake.sources.stage import staged

#: Cells of the table of word counts; words that share one are taken as equally rare.
RARITY_BITS = 17
#: Bits of a word's hash that order it within a line, and of its rarity before them.
HASH_BITS, CLASS_BITS = 38, 6
#: Rows of a prefix word, beyond which its rows are sliced and the slices meet pairwise,
#: and bits of a word that number the cells in which rows are counted first.
SLICE_ROWS, CELL_BITS = 16_384, 16
#: Postings that a task gathers before it deals them, and that a bucket has on average.
POSTED, BUCKET_ROWS = 1_000_000, 131_072
#: Earlier lines that a line is verified against first.
FIRST_TRIED = 1
#: Pairs compared at a time, and bytes of text hashed at a time (a longer text at once).
PAIRS, CHUNK_BYTES = 200_000, 125_000
#: Bits of the maps that say which lines and documents are concerned (2 MB, whatever the data).
MAP_BITS = 24

FACTOR = 0x9E3779B97F4A7C15


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the factor and of its inverse modulo 2**64."""
    held = worker_state("line_powers", lambda: [np.empty(0, np.uint64)] * 2)
    if len(held[0]) < n:
        inverse = pow(FACTOR, -1, 1 << 64)
        for k, base in enumerate((FACTOR, inverse)):
            steps = np.full(n + n // 2, base, np.uint64)
            steps[0] = 1
            held[k] = np.multiply.accumulate(steps)
    return held[0][:n], held[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of some texts together, the ends of each, and their numbers in the column."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield data[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at], np.arange(at, end)
        at = end


def begun(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines begin in the bytes of some texts, and for each line its text and number there."""
    begins = np.concatenate([[0], ends[:-1]])
    breaks = np.flatnonzero(raw == 10)
    # lines begin at the beginning of a text and behind a line break
    heads = np.unique(np.concatenate([begins[begins < len(raw)], breaks[breaks + 1 < len(raw)] + 1]))
    of_text = np.searchsorted(ends, heads, side="right")
    return heads, of_text, np.searchsorted(breaks, heads) - np.searchsorted(breaks, begins)[of_text]


def hashed(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with their line, and for each line its text and number there."""
    if not len(raw):
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    space = space_table()[raw]
    first = np.append(True, space[:-1])
    begins = np.concatenate([[0], ends[:-1]])
    first[begins[begins < len(raw)]] = True  # a text does not go on in the next
    starts = np.flatnonzero(first & ~space)
    last = np.append(space[1:], True)
    last[ends[ends > 0] - 1] = True
    stops = np.flatnonzero(last & ~space)
    up, down = powers(len(raw) + 1)
    total = np.cumsum((lower_table()[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    words = mixed((total[stops] - before) * down[starts])
    heads, of_text, number = begun(raw, ends)
    return words, np.searchsorted(heads, starts, side="right") - 1, of_text, number


def rarity(docs: DataFrame, text: str) -> np.ndarray:
    """Occurrences of the words of all documents, by the last bits of their hash."""
    cells = 1 << RARITY_BITS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for raw, ends, _ in chunks(batch.column(0)):
                h = hashed(raw, ends)[0]
                total += np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": found.astype(np.int32), "n": total[found]})

    texts = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    counts = texts.mapInArrow(lean(tally), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(cells, np.int64)
    table[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    return table


def overlap(similarity: float, total):
    """The least overlap of two sets with ``total`` words together, as a Column or array."""
    need = similarity / (1 + similarity) * total
    return F.ceil(need - 1e-9) if isinstance(need, Column) else np.ceil(need - 1e-9)


def line_sets(docs: DataFrame, id_col: str, text: str, similarity: float, least_words: int) -> DataFrame:
    """``doc, line, sig, bits, more_bits, n, gone, prefix`` for each line of at least ``least_words`` different words.

    Of equal sets in one batch all lines but the first are ``gone`` and have no prefix.
    """
    table = rarity(docs, text)
    classes = np.minimum(2 * np.log2(table + 1), (1 << CLASS_BITS) - 1).astype(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows for raw, ends, which in chunks(batch.column(1)) for rows in sets(raw, ends, which)]
            if not found:
                continue
            text_at, number, sig, bits, more_bits, n, length, tokens = (np.concatenate([r[k] for r in found]) for k in range(8))
            doc = batch.column(0).to_numpy()[text_at]
            order = np.lexsort((number, doc, bits, sig))
            s, b, d, k = sig[order], bits[order], doc[order], number[order]
            head = np.append(True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]))
            of = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
            gone, twice = np.zeros(len(s), bool), np.zeros(len(s), bool)
            gone[order] = (d != d[of]) | (k != k[of])
            twice[order] = ~head  # a repeated row has its lines at the same places
            keep = gone | ~twice
            starts = np.cumsum(length) - length
            mine = np.where(gone, 0, length)[keep]
            tokens = tokens[ragged(starts[keep], mine)]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mine)]).astype(np.int32)), pa.array(tokens))
            signs = (sig.view(np.int64), bits.view(np.int64), more_bits.view(np.int64))
            columns = (doc, number.astype(np.int32), *signs, n.astype(np.int32), gone)
            arrays = [*(pa.array(c[keep]) for c in columns), prefix]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "line", "sig", "bits", "more_bits", "n", "gone", "prefix"])

    def sets(raw: np.ndarray, ends: np.ndarray, which: np.ndarray) -> Iterator[tuple]:
        h, line, of_text, number = hashed(raw, ends)
        step = 1 << (64 - HASH_BITS - CLASS_BITS)
        for low in range(0, len(of_text), step):
            mine = slice(*np.searchsorted(line, [low, low + step]))
            key = (line[mine] - low).astype(np.uint64) << np.uint64(HASH_BITS + CLASS_BITS)
            key |= sent.value[(h[mine] & np.uint64((1 << RARITY_BITS) - 1)).astype(np.int64)] << np.uint64(HASH_BITS)
            key |= h[mine] >> np.uint64(64 - HASH_BITS)
            if not len(key):
                continue
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            where = (key >> np.uint64(HASH_BITS + CLASS_BITS)).astype(np.int64) + low
            starts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            n = np.diff(np.append(starts, len(key)))
            word = key & np.uint64((1 << HASH_BITS) - 1)
            sig = np.add.reduceat(mixed(word * np.uint64(FACTOR)), starts)
            bit, half = np.uint64(1) << (word & np.uint64(63)), (word >> np.uint64(6)) & np.uint64(1)
            # parities: where two sets' bits differ, some word is in one of them only
            bits = np.bitwise_xor.reduceat(bit * (np.uint64(1) - half), starts)
            more_bits = np.bitwise_xor.reduceat(bit * half, starts)
            keep = n >= least_words
            starts, n, sig, bits, more_bits, at = starts[keep], n[keep], sig[keep], bits[keep], more_bits[keep], where[starts[keep]]
            length = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            # a set so short that one word more or less is too much has no match but equal sets
            length[n < similarity * (n + 1) - 1e-9] = 0
            tokens = (word[ragged(starts, length)] >> np.uint64(HASH_BITS - 32)).astype(np.uint32).view(np.int32)
            yield which[of_text[at]], number[at], sig, bits, more_bits, n, length, tokens

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    return known.mapInArrow(lean(prepare), "doc long, line int, sig long, bits long, more_bits long, n int, gone boolean, prefix array<int>")


def marked(cells: DataFrame) -> np.ndarray:
    """A bit for each ``cell``, a number below 2**MAP_BITS; the map has a fixed size."""
    # Spark counts the positions of its bitmaps from one
    at = F.col("cell").cast("long") + 1
    parts = cells.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = (row["part"] - 1) * 4096
        whole[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return whole


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def line_cell(doc, line):
    """The number of a line's cell; for numbers, arrays and columns alike."""
    size = 1 << MAP_BITS
    if isinstance(doc, Column):
        return F.pmod(F.pmod(doc, F.lit(size)) * 31_337 + line.cast("long") * 7_919, F.lit(size))
    return (doc % size * 31_337 + line * 7_919) % size


def length_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """A class of lengths; similar sets are in one class or in neighbouring ones."""
    return np.floor(np.log(n) / -np.log(similarity - 1e-6)).astype(np.int64)


def word_cell(token: np.ndarray, class_: np.ndarray) -> np.ndarray:
    """The number of the cell of a word at some length."""
    h = mixed((token.astype(np.uint64) + (class_.astype(np.uint64) << np.uint64(32))) * np.uint64(FACTOR))
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def asked_cells(unique: DataFrame, of_lines: np.ndarray, similarity: float) -> DataFrame:
    """``cell`` of the words and lengths that prefixes of some lines may meet; a map leaves nearly no other lines."""
    lines_sent = unique.sparkSession.sparkContext.broadcast(of_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = has(lines_sent.value, line_cell(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)))
            lists, n = batch.column(3).filter(pa.array(mine)), batch.column(2).to_numpy()[mine]
            class_ = np.repeat(length_class(n, similarity), lists.value_lengths().to_numpy(zero_copy_only=False))
            token = lists.flatten().to_numpy().view(np.uint32)
            yield pa.RecordBatch.from_pydict({"cell": np.unique(np.concatenate([word_cell(token, class_ + k) for k in (-1, 0, 1)])).astype(np.int32)})

    return unique.where("size(prefix) > 0").select("doc", "line", "n", "prefix").mapInArrow(lean(run), "cell int")


Hot = tuple[np.ndarray, np.ndarray, int]


def hot_words(unique: DataFrame) -> Hot:
    """The prefix words with more than ``SLICE_ROWS`` rows, their numbers of slices, and the rows of all words.

    Rows are counted by cell first, in a table of fixed size; only in cells with so many
    rows can such a word be, and only their words are counted one by one.  Of
    ``SLICE_ROWS`` rows there is one such word at most.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            token = batch.column(0).flatten().to_numpy().view(np.uint32)
            total += np.bincount(token >> np.uint32(32 - CELL_BITS), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": found.astype(np.int32), "n": total[found]})

    prefixes = unique.where("prefix is not null").select("prefix")
    counted = prefixes.mapInArrow(lean(tally), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = counted.column("cell").to_numpy(), counted.column("n").to_numpy()
    full = np.zeros(1 << CELL_BITS, bool)
    full[cell[n > SLICE_ROWS]] = True
    if not full.any():
        return np.empty(0, np.uint32), np.empty(0, np.int64), int(n.sum())
    sent = unique.sparkSession.sparkContext.broadcast(full)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(0).flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"token": token[sent.value[token.view(np.uint32) >> np.uint32(32 - CELL_BITS)]]})

    words = prefixes.mapInArrow(lean(pick), "token int").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SLICE_ROWS)
    hot = words.toArrow()
    token, rows = hot.column("token").to_numpy().view(np.uint32), hot.column("n").to_numpy()
    order = np.argsort(token)
    slices = -(-rows // SLICE_ROWS)
    return token[order], slices[order], int(n.sum() + ((slices - 1) * rows).sum())


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of unsigned numbers as bytes, each number in as few as the largest needs."""
    kind = np.min_scalar_type(values.max(initial=0))
    buffers = [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def unpacked(runs: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of packed runs, one run after the other; a plain number is all of its run."""
    if pa.types.is_integer(runs.type):
        return np.repeat(runs.to_numpy().astype(np.uint64), sizes)
    parts = [np.frombuffer(raw, f"u{len(raw) // size}") for raw, size in zip(runs.to_pylist(), sizes.tolist(), strict=True)]
    return np.concatenate(parts, dtype=np.uint64)


def postings(unique: DataFrame, hot_found: Hot, similarity: float, of_words: np.ndarray | None = None) -> DataFrame:
    """``bucket, size, word, doc, line, bits, more_bits, n, i``: the rows of prefix words, dealt by word.

    A row holds some rows of some words of one bucket, ``size`` of them, as packed numbers;
    ``i`` is the place in the prefix.  A word with many rows is dealt in pairs of slices,
    each a word of its own.  Words are hashes; where two are taken for one, lines meet
    that need not.  A map leaves nearly nothing but words at lengths that are asked for.
    """
    token, slices, total = hot_found
    buckets = np.uint64(max(1, -(-total // BUCKET_ROWS)))
    sent = unique.sparkSession.sparkContext.broadcast((token, slices, of_words))

    def posted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, line, bits, more_bits, n = (table.column(c).to_numpy() for c in range(5))
        lists = table.column(5).chunk(0)
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        of, i = np.repeat(np.arange(len(lists)), length), ragged(np.zeros(len(lists), np.int64), length)
        word = lists.flatten().to_numpy().view(np.uint32)
        hot, times, asked = sent.value
        if asked is not None:
            keep = has(asked, word_cell(word, length_class(n, similarity)[of]))
            word, of, i = word[keep], of[keep], i[keep]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
            parts = np.where(hot[at] == word, times[at], 1)
            own = (mixed(doc[of].view(np.uint64) * np.uint64(FACTOR) + line[of].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            row, other = np.repeat(np.arange(len(word)), parts), ragged(np.zeros(len(word), np.int64), parts)
            pair = np.minimum(own[row], other) * parts[row] + np.maximum(own[row], other)
            word, of, i, alone = word[row], of[row], i[row], parts[row] == 1
            word = np.where(alone, word, (mixed((word + (pair.astype(np.uint64) << np.uint64(32))) * np.uint64(FACTOR)) >> np.uint64(32)).astype(np.uint32))
        bucket = mixed(word.astype(np.uint64) * np.uint64(FACTOR)) % buckets
        order = np.argsort((bucket << np.uint64(32)) | word)
        bucket, of = bucket[order], of[order]
        bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
        columns = {"word": word[order], "doc": doc[of].view(np.uint64), "line": line[of].view(np.uint32), "bits": bits[of].view(np.uint64)}
        columns |= {"more_bits": more_bits[of].view(np.uint64), "n": n[of].view(np.uint32), "i": i[order].astype(np.uint32)}
        numbers = {"bucket": bucket[bounds[:-1]].astype(np.int32), "size": np.diff(bounds).astype(np.int32)}
        return pa.RecordBatch.from_pydict(numbers | {name: packed(values, bounds) for name, values in columns.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch.column(5).flatten())
            if count >= POSTED:
                yield posted(held)
                held, count = [], 0
        if count:
            yield posted(held)

    rows = unique.where("size(prefix) > 0").select("doc", "line", "bits", "more_bits", "n", "prefix")
    kinds = "bucket int, size int, word binary, doc binary, line binary, bits binary, more_bits binary, n binary, i binary"
    return rows.mapInArrow(lean(deal), kinds).repartition("bucket").sortWithinPartitions("bucket")


def promising(rows: DataFrame, similarity: float) -> DataFrame:
    """``doc, line, other_doc, other_line, more``: the earlier lines with the highest bound on similarity.

    Each word gives ``FIRST_TRIED`` for a line at most; ``more`` says that some word has
    further ones.
    """
    return earlier_lines(rows, similarity, None)


def all_near(rows: DataFrame, similarity: float, of_lines: np.ndarray) -> DataFrame:
    """As ``promising``, with all earlier lines that the bound allows, for the lines of a map and hardly any others."""
    return earlier_lines(rows, similarity, of_lines)


def earlier_lines(rows: DataFrame, similarity: float, of_lines: np.ndarray | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(of_lines)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"], 1):
            bounds = group_bounds(table, ["bucket"])
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield meet(table.slice(low, high - low))

    def meet(bucket: pa.Table) -> pa.RecordBatch:
        sizes = bucket.column("size").to_numpy()
        word, n = unpacked(bucket.column("word"), sizes), unpacked(bucket.column("n"), sizes)
        key = (word << np.uint64(32)) | n
        order = np.argsort(key)
        key, word, n = key[order], word[order], n[order].astype(np.int64)
        doc, line, bits, more_bits, i = (unpacked(bucket.column(c), sizes)[order] for c in ("doc", "line", "bits", "more_bits", "i"))
        doc, line, i = doc.view(np.int64), line.astype(np.int32), i.astype(np.int64)
        # a row meets the rows behind it, of sets as long or longer; where the sets match, their
        # first common word is among the words here that the shorter one has beyond the least overlap
        longest = np.minimum(np.floor(n / similarity + 1e-6), 2**32 - 1).astype(np.uint64)
        upto_row = np.searchsorted(key, (word << np.uint64(32)) | longest, side="right")
        at_row = np.arange(len(key))
        from_row = at_row + 1
        met = i <= n - overlap(similarity, 2 * n)
        if sent.value is not None:
            # lines in question meet the shorter ones as well
            shortest = np.ceil(n * similarity - 1e-6).astype(np.uint64)
            from_row = np.searchsorted(key, (word << np.uint64(32)) | shortest)
            met = has(sent.value, line_cell(doc, line.astype(np.int64)))
        behind = np.where(met, upto_row - from_row, 0)
        upto = np.cumsum(behind)
        later_row = earlier_row = np.empty(0, np.int64)
        score, more = np.empty(0), np.zeros(len(key), bool)
        found: list[tuple] = []
        rest, at = n - i, 0
        while at < len(key):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
            a = np.repeat(at_row[at:end], behind[at:end])
            b = ragged(from_row[at:end], behind[at:end])
            at = end
            total = n[a] + n[b]
            need = overlap(similarity, total)
            some = np.flatnonzero(np.minimum(rest[a], rest[b]) >= need)
            a, b, total, need = a[some], b[some], total[some], need[some]
            differ = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) + np.bitwise_count(more_bits[a] ^ more_bits[b])
            shared = np.minimum((total - differ) // 2, np.minimum(rest[a], rest[b]))
            near = np.flatnonzero(shared >= need)
            a, b, shared, total = a[near], b[near], shared[near], total[near]
            later = (doc[a] > doc[b]) | ((doc[a] == doc[b]) & (line[a] > line[b]))
            if sent.value is not None:
                found.append((a[later], b[later]))
                continue
            later_row = np.concatenate([later_row, np.where(later, a, b)])
            earlier_row = np.concatenate([earlier_row, np.where(later, b, a)])
            score = np.concatenate([score, shared / (total - shared)])
            if len(later_row) < PAIRS and at < len(key):
                continue
            order = np.lexsort((line[earlier_row], doc[earlier_row], -score, later_row))
            head = np.append(True, np.diff(later_row[order]) != 0)[: len(order)]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            more[later_row[order[rank >= FIRST_TRIED]]] = True
            keep = order[rank < FIRST_TRIED]
            later_row, earlier_row, score = later_row[keep], earlier_row[keep], score[keep]
        if found:
            later_row, earlier_row = (np.concatenate(rows) for rows in zip(*found, strict=True))
        return pa.RecordBatch.from_pydict({
            "doc": doc[later_row], "line": line[later_row], "other_doc": doc[earlier_row], "other_line": line[earlier_row], "more": more[later_row],
        })

    found = rows.mapInArrow(lean(search), "doc long, line int, other_doc long, other_line int, more boolean")
    return found.groupBy("doc", "line", "other_doc", "other_line").agg(F.max("more").alias("more"))


def verified(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, similarity: float) -> DataFrame:
    """``doc, line, same, more`` for each line of the pairs: whether one is that similar, and the pairs' ``more``.

    The texts are scanned once more; a map of fixed size of the lines in question lets
    nearly no others leave the scan.
    """
    ends = pairs.select("doc", "line").union(pairs.select(F.col("other_doc"), F.col("other_line")))
    sent = docs.sparkSession.sparkContext.broadcast(marked(ends.select(line_cell(F.col("doc"), F.col("line")).alias("cell"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for raw, ends, which in chunks(batch.column(1)):
                heads, of_text, number = begun(raw, ends)
                doc = ids[which[of_text]]
                mine = np.flatnonzero(has(sent.value, line_cell(doc, number)))
                # up to the line break, or where the text ends
                breaks = np.append(np.flatnonzero(raw == 10), len(raw))
                stops = np.minimum(breaks[np.searchsorted(breaks, heads[mine])], ends[of_text[mine]])
                lines = [raw[a:b].tobytes() for a, b in zip(heads[mine].tolist(), stops.tolist(), strict=True)]
                columns = [pa.array(doc[mine]), pa.array(number[mine].astype(np.int32)), pa.array(lines, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "line", "raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (map(lambda raw: set(raw.lower().split()), column(batch, c)) for c in ("raw", "other_raw"))
            same = [len(x & y) >= overlap(similarity, len(x) + len(y)) for x, y in zip(a, b, strict=True)]
            yield batch.drop_columns(["raw", "other_raw"]).append_column("same", pa.array(same, pa.bool_()))

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    texts = staged(known.mapInArrow(lean(pick), "doc long, line int, raw binary"))
    others = texts.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("raw").alias("other_raw"))
    both = pairs.join(texts, ["doc", "line"]).join(others, ["other_doc", "other_line"]).select("doc", "line", "more", "raw", "other_raw")
    compared = both.mapInArrow(lean(compare), "doc long, line int, more boolean, same boolean")
    return compared.groupBy("doc", "line").agg(F.max("same").alias("same"), F.max("more").alias("more"))


def repeated_lines(docs: DataFrame, *, id_col: str, text: str, similarity: float, least_words: int) -> DataFrame:
    """``doc, line`` of every line that an earlier one matches, by id and line number.

    Of equal sets at most one line a batch gets to the ranking, so a line that a third of
    all documents share is no large group there.
    """
    sets = line_sets(docs, id_col, text, similarity, least_words)
    # a column of its own and both numbers at once, so that the rows are shuffled once
    keyed = sets.withColumn("_own", F.when(F.col("gone"), F.xxhash64("doc", "line")))
    in_order = Window.partitionBy("sig", "bits", "more_bits", "_own").orderBy("doc", "line")
    ranked = keyed.select("*", F.first(F.struct("doc", "line")).over(in_order).alias("first"), F.row_number().over(in_order).alias("place"))
    moved = (F.col("doc") != F.col("first.doc")) | (F.col("line") != F.col("first.line"))
    prefix = F.when((F.col("place") == 1) & ~F.col("gone"), F.col("prefix"))
    unique = staged(ranked.select("doc", "line", "bits", "more_bits", "n", prefix.alias("prefix"), (F.col("gone") | moved).alias("gone")))
    equal = unique.where("gone").select("doc", "line")

    hot = hot_words(unique)
    tried = staged(promising(postings(unique, hot, similarity), similarity))
    checked = staged(verified(docs, id_col, text, tried, similarity))
    gone = equal.union(checked.where("same").select("doc", "line"))
    open_ = checked.where("more and not same").select("doc", "line")
    if open_.isEmpty():
        return gone

    # lines of which all promising candidates failed meet all others
    of_lines = marked(open_.select(line_cell(F.col("doc"), F.col("line")).alias("cell")))
    of_words = marked(asked_cells(unique, of_lines, similarity))
    met = all_near(postings(unique, hot, similarity, of_words), similarity, of_lines)
    others = met.join(open_, ["doc", "line"], "left_semi").join(tried, ["doc", "line", "other_doc", "other_line"], "left_anti")
    return gone.union(verified(docs, id_col, text, staged(others), similarity).where("same").select("doc", "line"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, least_words: int = 1) -> DataFrame:
    """``docs`` without lines that match an earlier line, with ``n_lines`` and ``n_removed``.

    A line matches an earlier one, by (id, line number), where the Jaccard similarity of
    their sets of words is at least ``similarity``; whether the earlier line is itself
    removed plays no part.  Lines of fewer than ``least_words`` different words stay, as
    do blank ones.  A line at the same place of a repeated row is the same line.  Rows
    without an id keep all lines, and a null text stays null with no lines.  Other columns
    stay; ``n_lines`` and ``n_removed`` are replaced.  Ids are whole numbers.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = repeated_lines(docs, id_col=id_col, text=text, similarity=similarity, least_words=least_words)
    by_doc = staged(gone.groupBy(F.col("doc").alias(id_col)).agg(F.collect_set("line").alias("_lines")))
    # only documents that may lose a line are shuffled to meet their lines, which grow with the input: no broadcast
    sent = docs.sparkSession.sparkContext.broadcast(marked(by_doc.select(F.pmod(id_col, F.lit(1 << MAP_BITS)).alias("cell"))))

    def concerned(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column(batch.schema.get_field_index(id_col))
        cells = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) % (1 << MAP_BITS)
        return has(sent.value, cells) & ids.is_valid().to_numpy(zero_copy_only=False)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(concerned(batch)))

    def counted(batch: pa.RecordBatch, total: list[int], removed: list[int]) -> pa.RecordBatch:
        return batch.append_column("n_lines", pa.array(total, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    def n_lines(value: str | None) -> int:
        return value.count("\n") + 1 if value else 0

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_to(batch.filter(pa.array(~concerned(batch))), TEXTS_AT_ONCE):
                yield counted(part, [n_lines(value) for value in column(part, text)], [0] * part.num_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_to(batch, TEXTS_AT_ONCE):
                kept, total, removed = [], [], []
                for value, numbers in zip(column(part, text), column(part, "_lines"), strict=True):
                    drop = set(numbers or ())
                    total.append(value.count("\n") + 1 if drop else n_lines(value))
                    if drop:
                        value = "\n".join(s for k, s in enumerate(value.split("\n")) if k not in drop)
                    kept.append(value)
                    removed.append(len(drop))
                out = part.drop_columns(["_lines"])
                out = out.set_column(out.schema.get_field_index(text), text, pa.array(kept, pa.string()))
                yield counted(out, total, removed)

    schema = widened(docs, n_lines="long", n_removed="long")
    some = docs.mapInArrow(lean(pick), docs.schema).join(by_doc.hint("merge"), id_col, "left").select(*docs.columns, "_lines")
    # apart, so that no task has two Python workers
    return docs.mapInArrow(lean(others), schema).unionByName(some.mapInArrow(lean(cut), schema))
