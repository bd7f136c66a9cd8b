"""Mixture-controlled packing of documents into token sequences.

Each source is a queue of document parts.  Deficit round-robin serves the queues: in
every round a source earns its share of a window in tokens, and a part leaves its queue
in the first round in which the source has earned all tokens up to the part's end; what
it has earned beyond is carried on.  As earnings only add up, that round follows from the
part's place in its queue alone.  So the order of service is a sort by (round, source,
place), and places, rounds and offsets are sums over blocks of rows: deficits carry over
windows and partitions without a task that sees a whole queue.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import TEXTS_AT_ONCE, column, file_bytes, forget_others, lean, map_batches, widened, worker_state
from entitylake.sources.stage import staged

#: Tokens of a part of a document in its queue: long documents do not fill a window alone.
PART_TOKENS = 256
#: Rows that one task orders, and the most blocks whose sums one task adds up.
BLOCK_ROWS, MOST_BLOCKS = 4_000, 8_192
#: Entries of a worker's cache of encoded words, of those put together from others, and the longest it keeps.
CACHED, CACHED_JOINED, CACHED_LENGTH = 250_000, 100_000, 48

SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!&%$#*|?;:]*)")


def byte_level() -> dict[int, str]:
    """The character for each byte: printable ones stand for themselves, others follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoded(dict):
    """Token ids, as bytes, by what stands between two spaces or line breaks.

    The tokenizer drops white space before it merges, so such parts are independent.  A
    part of letters and a run of punctuation is split there as by the tokenizer's pattern
    and goes to its model at once; any other part goes through the whole tokenizer.  Words
    have most of the room, as they are costly; how they are written and what stands behind
    them makes many more parts, which are quickly joined from kept words.
    """

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.room, self.joined_room = tokenizer, CACHED, CACHED_JOINED
        self.pack = lambda n, ids: struct.pack(f"<{n}{'H' if kind == '<u2' else 'I'}", *ids)
        self.bytes_as = byte_level()
        self[""] = b""

    def __missing__(self, part: str) -> bytes:
        if found := SIMPLE.fullmatch(part):
            word, marks = found[1].lower(), found[2]
            if marks or word != part:
                ids = self[word] + self[marks]
                if self.joined_room and len(part) <= CACHED_LENGTH:
                    self.joined_room -= 1
                    self[part] = ids
                return ids
            mapped = word if word.isascii() else "".join(self.bytes_as[b] for b in word.encode())
            ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return self.keep(part, self.pack(len(ids), ids))

    def keep(self, part: str, ids: bytes) -> bytes:
        if self.room and len(part) <= CACHED_LENGTH:
            self.room -= 1
            self[part] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def encoder(spark, tokenizer_path: str) -> tuple[Callable[[], Encoded], str]:
    """What makes a worker's encoder, and the type of its ids."""
    from tokenizers import Tokenizer

    raw = file_bytes(tokenizer_path)
    kind = "<u2" if Tokenizer.from_buffer(raw).get_vocab_size() <= 65_536 else "<u4"
    sent = spark.sparkContext.broadcast(raw)

    def make() -> Encoded:
        from tokenizers import Tokenizer

        return Encoded(Tokenizer.from_buffer(sent.value), kind)

    return make, kind


def running_total(df: DataFrame, queue: list[str], block: str, order: list[str], value: str) -> Column | DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that come earlier in the queue.

    Rows come in order of (block, order).  A task orders the rows of one block or adds up
    the sums of blocks, never the rows of a queue.
    """
    sums = df.groupBy(*queue, block).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*queue).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*queue, block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*queue, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = rows.join(offsets, [*queue, block])
    return joined.withColumn("before", F.col("_offset") + F.col("_within")).drop("_offset", "_within")


def tail_bounds(total: int, window: int) -> list[int]:
    """Where sequences begin from the last full window on: powers of two, largest first."""
    bounds, at = [], total - total % window
    for power in reversed(range(max(window - 1, 1).bit_length())):
        if (total - at) >= 1 << power:
            bounds.append(at)
            at += 1 << power
    return [*bounds, total]


def queue_of(source: str) -> Column:
    """A null source is a queue of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    end_id: int = 2,
    window: int = 4096,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """A row per piece of a document: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Sequences hold ``window`` tokens without padding; the rest at the end is cut at powers
    of two.  ``shares`` gives the sources' weights, by default their shares of all tokens,
    so that all queues end together; a source it leaves out weighs as the least one named.
    An exhausted queue earns nothing more and the others fill the windows in proportion.
    Repeated rows and rows without an id are packed like any other, a null source is a
    source, further columns are not used.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    make, kind = encoder(spark, tokenizer_path)
    tier = f"encoded_{spark.sparkContext.applicationId}_{zlib.crc32(tokenizer_path.encode())}"
    ended = np.array([end_id], kind).tobytes()
    width = len(ended)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = worker_state(tier, make)
        ids = [encoded.text(t) + ended for t in column(batch, "text")]
        out = batch.drop_columns(["text"]).append_column("n", pa.array([len(i) // width for i in ids], pa.int64()))
        return out.append_column("ids", pa.array(ids, pa.binary()))

    plain = docs.select(F.col(id_col).alias("id"), queue_of(source).alias("queue"), F.col(text).alias("text"))
    rows = map_batches(plain, encode, widened(plain.drop("text"), n="long", ids="binary"), rows=TEXTS_AT_ONCE, state=tier)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))

    placed, total = place(rows.select("row", "queue", "n"), window, shares)
    bounds = tail_bounds(total, window)
    joined = rows.select("row", "id", "n", "ids").join(placed, "row").drop("row")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            out = {k: [] for k in ("doc", "start", "length", "crc", "n", "sequence", "offset")}
            for i, ids, n, parts in zip(*(column(batch, c) for c in ("id", "ids", "n", "parts")), strict=True):
                whole = np.frombuffer(ids, kind).astype("<u4")
                for start, length, sequence, offset in pieces(parts, bounds, window):
                    for key, value in zip(out, (i, start, length, zlib.crc32(whole[start : start + length].tobytes()), n, sequence, offset), strict=True):
                        out[key].append(value)
            arrays = [pa.array(out["doc"], batch.schema.field("id").type), *(pa.array(v, pa.int64()) for v in list(out.values())[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    schema = f"doc {id_type}, start long, length long, crc long, n long, sequence long, offset long"
    names = (id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return joined.mapInArrow(lean(cut), schema).toDF(*names)


def place(rows: DataFrame, window: int, shares: dict[str, float] | None) -> tuple[DataFrame, int]:
    """``row`` with its ``parts`` (start, length and place among all tokens), and the number of tokens."""
    size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    count, total = int(size[0]), int(size[1])
    blocks = min(MOST_BLOCKS, count // BLOCK_ROWS + 1)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queued = running_total(chunked, ["queue"], "chunk", ["row"], "n").withColumnRenamed("before", "queued")

    if shares:
        least = min(shares.values())
        weight = F.coalesce(F.create_map(*[F.lit(x) for s, w in shares.items() for x in (f"={s}", float(w))])[F.col("queue")], F.lit(float(least)))
        weights = rows.groupBy("queue").agg(F.lit(1)).select("queue", weight.alias("w"))
        whole = float(weights.agg(F.sum("w")).first()[0] or 1.0)
    else:
        weights, whole = rows.groupBy("queue").agg(F.sum("n").cast("double").alias("w")), float(max(total, 1))

    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART_TOKENS).cast("long")))
    parts = queued.join(weights, "queue").select("*", part.alias("start"))
    parts = parts.withColumn("length", F.least(F.lit(PART_TOKENS), F.col("n") - F.col("start")))
    end = F.col("queued") + F.col("start") + F.col("length")
    earned = F.col("w") / F.lit(whole) * window
    parts = parts.withColumn("round", F.ceil(end / earned)).withColumn("queue_end", end)
    parts = parts.select("row", "start", "length", "queue", "queue_end", "round")
    rounds = max(1, total // window + 2) if not shares else int(parts.agg(F.max("round")).first()[0] or 0) + 1
    bucket = F.floor(F.col("round") * F.lit(blocks) / F.lit(rounds)).cast("int")
    served = running_total(parts.withColumn("bucket", bucket), [], "bucket", ["round", "queue", "queue_end"], "length")
    entry = F.struct("start", "length", F.col("before").alias("at"))
    return served.groupBy("row").agg(F.collect_list(entry).alias("parts")), total


def pieces(parts: list[dict], bounds: list[int], window: int) -> Iterator[tuple[int, int, int, int]]:
    """The cuts of one document: parts that follow each other are joined, then cut where sequences end."""
    full = bounds[0] if len(bounds) > 1 else bounds[-1]
    merged: list[list[int]] = []
    for p in sorted(parts, key=lambda p: p["start"]):
        if merged and merged[-1][0] + merged[-1][1] == p["start"] and merged[-1][2] + merged[-1][1] == p["at"]:
            merged[-1][1] += p["length"]
        else:
            merged.append([p["start"], p["length"], p["at"]])
    for start, length, at in merged:
        while length:
            if at < full:
                sequence, begin, end = at // window, at - at % window, at - at % window + window
            else:
                k = int(np.searchsorted(bounds, at, side="right")) - 1
                sequence, begin, end = full // window + k, bounds[k], bounds[k + 1]
            take = min(length, end - at)
            yield start, take, sequence, at - begin
            start, length, at = start + take, length - take, at + take
