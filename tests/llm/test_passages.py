from __future__ import annotations

import random
import re

import pytest

from entitylake.llm import passages
from entitylake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(id, words, removed words, text left) by comparing all windows."""
    first: dict = {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in texts:
        if i is not None:
            for k in range(len(words) - window + 1):
                passage = tuple(words[k : k + window])
                first[passage] = min(first.get(passage, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((-1 if i is None else i, len(words), tuple(sorted(gone)), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


def result(df, kept="kept"):
    out = []
    for r in df.collect():
        gone = tuple(sorted(k for s in r["removed"] for k in range(s["start"], s["start"] + s["length"])))
        out.append((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], gone, r[kept]))
    return sorted(out)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shared_passages(seed):
    """Documents of few words that share many overlapping passages, repeated ids among them."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.7 else " ".join(str(rng.random()) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        words = " ".join(parts).split()
        if rng.random() < 0.5 and words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i // 2 if i % 7 == 0 else i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_odd_documents(odd_docs, no_docs):
    found = passages.without_repeated_passages(odd_docs)
    assert found.columns == [*odd_docs.columns, "kept", "n_words", "removed"]
    assert result(found) == brute(rows_of(odd_docs), 13)
    assert {r["n_tokens"] for r in found.collect()} == {"kept"}
    assert passages.without_repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_equals_comparison_of_all_windows(spark, seed):
    rows = shared_passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(passages.without_repeated_passages(df, window=6, gram=3)) == brute(rows, 6)
    # many blocks, every anchor hot, automata of a few rows
    split = passages.without_repeated_passages(df, window=6, gram=3, block_bytes=500, hot_docs=2, shard_rows=7)
    assert result(split) == brute(rows, 6)
    # an anchor as long as the window, and one of a single word
    assert result(passages.without_repeated_passages(df, window=6, gram=6)) == brute(rows, 6)
    assert result(passages.without_repeated_passages(df, window=5, gram=1, block_bytes=2_000)) == brute(rows, 5)


def test_equal_hashes_do_not_decide(spark, monkeypatch):
    """With all words of one hash every window meets every other; words still decide."""
    rows = shared_passages(5)[:20]
    monkeypatch.setattr(passages.Words, "hashes", lambda self: passages.np.ones(len(self), passages.np.uint64))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(passages.without_repeated_passages(df, window=6, gram=3, block_bytes=800, shard_rows=5)) == brute(rows, 6)


def test_long_passages_and_many_copies(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"own{i} before {passage} own{i} behind") for i in range(100, 0, -1)] + [(1, f"again {passage}"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(passages.without_repeated_passages(df, block_bytes=20_000)) == brute(rows, 13)


def test_names_that_clash(spark):
    rows = [(1, "a b c d e f g", 5, "x", "y"), (2, "a b c d e f g h", 6, "x", "y"), (3, None, 7, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id int, text string, kept int, _row string, _block string")
    found = passages.without_repeated_passages(df, window=3, gram=2)
    assert found.columns == ["doc_id", "text", "_row", "_block", "kept", "n_words", "removed"]
    assert [(r["_row"], r["_block"], r["kept"]) for r in found.orderBy("doc_id").collect()] == [
        ("x", "y", "a b c d e f g"),
        ("x", "y", "h"),
        ("x", "y", ""),
    ]
    with pytest.raises(ValueError):
        passages.without_repeated_passages(df, window=3, gram=4)


def test_texts_are_shuffled_once(spark, sf):
    df = QUERIES["op13_substring_dedup"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2
    assert final.count("FileScan") == 1


def test_query_against_all_windows(spark, sf):
    import hashlib

    docs = rows_of(spark.read.parquet(f"{sf}/documents.parquet"))
    expected = {(i, n, len(gone), hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute(docs, 13)}
    assert {tuple(r) for r in QUERIES["op13_substring_dedup"](spark, sf).collect()} == expected
