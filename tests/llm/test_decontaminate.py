from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from entitylake.llm import decontaminate
from entitylake.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    size = min(5, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else [], len(words)


def brute(documents, items, similarity=0.8):
    """The best weighted similarity of any window for each document and item."""
    known = {i: shingles(t) for i, t in items if shingles(t)[0]}
    df = Counter(s for v, _ in known.values() for s in set(v))
    weight = lambda s: math.log1p(len(known) / max(1, df.get(s, 1)))
    found = {}
    for d, t in documents:
        words = re.findall(r"\w+", (t or "").lower())
        for i, (item, size) in known.items():
            width = min(5, size)
            own = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
            a = Counter(item)
            for start in range(max(1, len(own) - len(item) + 1)) if own else ():
                b = Counter(own[start : start + len(item)])
                both = sum(min(c, b[s]) * weight(s) for s, c in a.items())
                value = both / (sum(c * weight(s) for s, c in a.items()) + sum(c * weight(s) for s, c in b.items()) - both)
                if value >= similarity - 1e-9:
                    found[d, i] = max(value, found.get((d, i), 0))
    return found


def result(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def same(found, expected):
    assert set(found) == set(expected)
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def changed(seed=0):
    """Documents with passages of items in which some words are changed."""
    rng = random.Random(seed)
    pool = [f"word{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 8, 20, 60, 120])))) for i in range(30)]
    documents = []
    for d in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 80))]
        if d % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in passage]
        documents.append((d, " ".join(words)))
    return documents, items


def test_equals_brute_force(spark):
    documents, items = changed()
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(documents, items)
    assert len(expected) > 40 and any(v < 1 for v in expected.values())
    same(result(decontaminate.contaminated(docs, bench)), expected)


def test_similarity_does_not_depend_on_blocks(spark):
    documents, items = changed(1)
    items = [(i, f"{t} as all items of this table say") for i, t in items]
    documents += [(1_000 + i, f"{t} but not here") for i, t in items]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(documents, items)
    assert any(v < 1 for v in expected.values())
    same(result(decontaminate.contaminated(docs, bench, block_items=7)), expected)


def test_blocks_of_items(spark):
    documents, items = changed(1)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = set(result(decontaminate.contaminated(docs, bench, block_items=7)))
    exact = {k for k, v in brute(documents, items).items() if v > 0.999}
    assert exact <= pairs


def test_query_equals_brute_force(spark, sf):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = [(d, t) for d, t in documents if len(t) < 20_000]
    found = {k: v for k, v in result(QUERIES["op7_benchmark_decontamination"](spark, sf)).items() if k[0] in dict(hit)}
    same(found, brute(hit, items))


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "one"), (4, "one"), (4, "one"), (5, "!!")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    rows = decontaminate.contaminated(odd_docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (2, 1), (6, 4)}
    kept = decontaminate.clean(odd_docs.withColumn("matches", odd_docs["score"]), bench.where("item_id = 1"))
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, None}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.limit(0)).count() == 0


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 20, replace=False):
            b ^= 1 << int(bit)
        assert set(decontaminate.blocks(a, 20)) & set(decontaminate.blocks(b, 20))
