from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from entitylake.llm import components, simhash
from entitylake.llm.queries import QUERIES


def brute_print(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op3_simhash_near_dedup"](spark, sf).collect()}
    prints = [brute_print(r["text"]) for r in docs]
    assert [rows[r["doc_id"]]["fingerprint"] for r in docs] == [f"{p:016x}" for p in prints]
    assert [rows[r["doc_id"]]["component_id"] for r in docs] == brute_components([r["doc_id"] for r in docs], prints, 4)


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[3]["fp"] == by_id[4]["fp"] == by_id[5]["fp"] == 0
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert by_id[None]["component_id"] is None


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_walk_finds_each_pair_once(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for _ in range(400)], np.uint64)
    fp = np.unique(np.concatenate([base, base[rng.integers(0, 40, 400)] ^ flips]))
    pairs = [p for a, b in simhash.walk(fp, np.array([0, len(fp)]), radius) for p in zip(a.tolist(), b.tolist(), strict=True)]
    brute = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute


def test_near_fingerprints_share_a_trie():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for k in range(5):
        other = fp.copy()
        for bit in range(k):
            other ^= np.uint64(1) << ((np.uint64(7 * bit) + fp) % np.uint64(64))
        keys, others = simhash.trie_keys(fp, 4), simhash.trie_keys(other, 4)
        assert (keys == others).any(1).all()


def test_slices_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TRIE_ROWS", 8)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, int(k)))) for k in rng.integers(0, 5, 150)})
    rows = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in enumerate(prints)]
    links = simhash.near_links(spark.createDataFrame(rows, "id long, fp long"), 4)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(range(len(prints)), prints, 4)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(None, 3), (4, 4)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(101, 161)} == {100} and {found[k] for k in range(200, 260)} == {5}
    assert 3 not in found and 4 not in found
