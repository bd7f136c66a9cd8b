"""Token counts of whole texts by a map-side lookup in two tiers.

The first tier is a broadcast hash table with the token counts of frequent pre-tokens;
it is fitted on a bounded sample and only saves time.  The second tier is a cache in
each Python worker; what neither has is encoded by the library.  Pre-tokens are never
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, file_bytes, map_batches, widened, worker_state

#: Rows from which the table of frequent pre-tokens is fitted, and its entries.
SAMPLE_ROWS, FREQUENT = 1_000, 50_000
#: Entries of a worker's cache, and the longest pre-token it keeps.
CACHED, CACHED_LENGTH = 250_000, 48


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that the model encodes independently.

    The model marks each space and puts one before the text; no piece of its vocabulary
    has a mark behind another character, so no merge crosses from a non-space to a space.
    A part is a run of spaces with what follows it, less the first space.  A text's own
    marks are spaces to the model.
    """
    if "▁" in text:
        text = text.replace("▁", " ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [part[1:] for part in re.findall(r" +[^ ]*", " " + text)]


def crossing_pieces(pieces: list[str]) -> list[str]:
    """Pieces that a cut into pre-tokens would break."""
    return [p for p in pieces if re.search("[^▁]▁", p)]


class Lengths(dict):
    """Token counts by pre-token: first the frequent ones, then those met so far."""

    def __init__(self, frequent: dict[str, int], encode: Callable[[str], list[int]]):
        super().__init__(frequent)
        self.encode, self.room = encode, CACHED
        # a lone mark, where a text ends with a space; alone, no library call gives it
        self[""] = len(encode("a ")) - len(encode("a"))

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part))
        if self.room and len(part) <= CACHED_LENGTH:
            self.room -= 1
            self[part] = n
        return n


def frequent_lengths(docs: DataFrame, text: str, encode: Callable[[str], list[int]]) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of rows."""

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for value in column(batch, text):
            if value:
                counts.update(p for p in pre_tokens(value) if len(p) <= CACHED_LENGTH)
        top = counts.most_common(FREQUENT)
        return pa.RecordBatch.from_pydict({"part": [p for p, _ in top], "n": [n for _, n in top]})

    sample = docs.select(text).limit(SAMPLE_ROWS)
    parts = map_batches(sample, tally, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    top = parts.orderBy(F.desc("n"), "part").limit(FREQUENT).select("part").collect()
    return {row["part"]: len(encode(row["part"])) for row in top}


def token_counts(docs: DataFrame, model_path: str, *, text: str = "text", token_limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of the whole text.

    ``model_path`` names a sentencepiece model.  No begin, end or other special tokens are
    added.  A null or empty text has no bytes and no tokens.  Other columns, nulls in them
    and repeated rows are kept; a column of ``docs`` with the name of a new one is replaced.
    """
    import sentencepiece

    model = file_bytes(model_path)
    driver = sentencepiece.SentencePieceProcessor(model_proto=model)
    if crossing := crossing_pieces([driver.id_to_piece(i) for i in range(driver.get_piece_size())]):
        raise ValueError(f"pieces go beyond a pre-token: {crossing[:3]}")
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(frequent_lengths(docs, text, driver.encode))
    sent = context.broadcast(model)
    tier = f"lengths_{frequent._jbroadcast.id()}_{context.applicationId}"

    def make() -> Lengths:
        import sentencepiece

        return Lengths(frequent.value, sentencepiece.SentencePieceProcessor(model_proto=sent.value).encode)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup = worker_state(tier, make).__getitem__
        n_bytes, n_tokens = [], []
        for value in column(batch, text):
            n_bytes.append(len(value.encode()) if value else 0)
            n_tokens.append(sum(map(lookup, pre_tokens(value))) if value else 0)
        out = batch.append_column("n_bytes", pa.array(n_bytes, pa.int64()))
        out = out.append_column("n_tokens", pa.array(n_tokens, pa.int64()))
        return out.append_column("over_limit", pa.array([n > token_limit for n in n_tokens]))

    return map_batches(docs, count, widened(docs, n_bytes="long", n_tokens="long", over_limit="boolean"), state=tier)
