from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from entitylake.llm import packing
from entitylake.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(rows, documents, window):
    """Sequences without gaps, full or a power of two; each id in one piece."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = {}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes[s] = at
        assert at == window or at & (at - 1) == 0
    assert sorted(sizes) == list(range(len(sizes)))
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    texts = Counter((d, t) for d, t in documents)
    for (doc, text), copies in texts.items():
        whole, at = ids(text), 0
        while at < len(whole):
            found = [p for p, n in pieces.items() if p[0] == doc and p[1] == at and p[4] == len(whole) and p[3] == zlib.crc32(whole[at : at + p[2]].tobytes())]
            assert found and copies >= 1
            at += found[0][2]
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) for _, t in documents)


def test_odd_rows(odd_docs):
    documents = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(packing.pack(odd_docs, PATH, window=256).collect(), documents, 256)


@pytest.mark.parametrize("part", ["Word.", "naïve", "ÉTÉ!!", "it's", "a1b", "<|endoftext|>x", "x\ny", "漢字", "don't.", "a_b", "Straße"])
def test_a_part_has_the_tokenizers_ids(part):
    assert packing.Encoded(LIBRARY, "<u4").text(part) == ids(part)[:-1].tobytes()


def test_line_breaks_part_words_and_words_keep_the_room():
    """Neither parts across a line break nor ways of writing a word take the room of words."""
    encoded = packing.Encoded(LIBRARY, "<u4")
    text = "Abc.\nabc, ABC!\n\nabc\n"
    assert encoded.text(text) == ids(text)[:-1].tobytes()
    assert "Abc.\nabc," not in encoded and "abc" in encoded
    assert packing.CACHED - encoded.room == len({"abc", ".", ",", "!"})
    assert packing.CACHED_JOINED - encoded.joined_room == len({"Abc.", "abc,", "ABC!"})
    encoded.room = encoded.joined_room = 0
    assert encoded.text("Wholly Unkept words.\nAbc. ABC?") == ids("Wholly Unkept words.\nAbc. ABC?")[:-1].tobytes()


def test_query_fills_windows_in_proportion(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op5_packing"](spark, sf).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs], 4096)
    source = {r["doc_id"]: r["source"] for r in docs}
    share, held = Counter(), defaultdict(Counter)
    for r in rows:
        share[source[r["doc_id"]]] += r["length"]
        held[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    total = sum(share.values())
    run = Counter()
    for s in sorted(held):
        run += held[s]
        done = sum(run.values())
        for name in share:  # what a source has had never strays by more than a few parts
            assert abs(run[name] - done * share[name] / total) <= 3 * packing.PART_TOKENS


def test_given_shares_hold_while_queues_last(spark):
    texts = [(i, "token " * 300, "a" if i % 2 else "b") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = packing.pack(docs, PATH, window=1024, shares={"a": 3.0, "b": 1.0}).collect()
    first = [r for r in rows if r["sequence_id"] < 8]
    had = Counter()
    for r in first:
        had["a" if r["doc_id"] % 2 else "b"] += r["length"]
    assert abs(had["a"] / sum(had.values()) - 0.75) < 0.08
    assert sum(r["length"] for r in rows) == 80 * 301


def test_tail_bounds():
    assert packing.tail_bounds(4096 + 13, 4096) == [4096, 4104, 4108, 4109]
    assert packing.tail_bounds(8192, 4096) == [8192]
    assert packing.tail_bounds(0, 4096) == [0]


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
