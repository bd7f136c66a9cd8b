from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from entitylake.llm import shingles
from entitylake.llm.simhash import fingerprint_of, near_links, shingle_hashes
from entitylake.sources.stage import release


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_groups(texts, similarity=0.8):
    own = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(own):
        for j in range(i):
            if x == own[j] or (x and len(x & own[j]) >= similarity * len(x | own[j]) - 1e-9):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    return label


def near_copies(seed, families=12, copies=12):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "four words are here"]
    for _ in range(families):
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5_000)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("slice_rows, few", [(3, 8), (4_096, 8), (4_096, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, slice_rows, few):
    monkeypatch.setattr(shingles, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(shingles, "FEW", few)
    texts = near_copies(1)
    expected = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    rows = sorted((r["k"], r["component"]) for r in shingles.similar_groups(docs).collect())
    first = {}
    assert [first.setdefault(c, k) for k, c in rows] == expected
    assert 20 < len(set(expected)) < len(texts) - 20


def test_similar_sets_share_the_needed_prefix_hashes():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(3_000):
        common = rng.integers(0, 1 << 62, rng.integers(1, 60))
        a, b = (np.unique(np.append(common, rng.integers(0, 1 << 62, rng.integers(0, 12)))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9:
            seen += 1
            x, y = (h[: shingles.prefix_length(np.int64(len(h)), 0.8)] for h in (a, b))
            assert len(np.intersect1d(x, y)) >= shingles.shared_hashes(np.array([len(a)]), np.array([len(b)]), 0.8)[0] >= 1
    assert seen > 500


def test_levels_count_texts_and_never_fall_short():
    h = np.arange(1, 5, dtype=np.uint64)
    maps = [np.zeros(1 << 13, np.uint8) for _ in range(3)]
    for bits, members in zip(maps, ([2, 3, 4], [3, 4], [4]), strict=True):
        for m in members:
            bits[m >> 3] |= 1 << (m & 7)
    assert shingles.levels(maps, h).tolist() == [0, 1, 2, 3]
    assert shingles.levels(maps, h[:0]).tolist() == []


def test_stage_keeps_one_of_near_copies_beyond_four_bits(spark, sf):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5_000)}" for _ in range(150)]
    rows = []
    for k in range(8):
        words = list(base)
        words[10 + 15 * k] = f"changed{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()] == [0]
    release(spark)


def test_stage_keeps_one_row_without_ids_and_of_repeated_rows(spark, sf):
    one, two, three = ("".join(f"{w}{k} " for k in range(30)) for w in "abc")
    rows = [(7, one), (7, one), (None, one), (None, two), (None, two), (9, three), (9, three + "end"), (8, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"][:3]) for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == [(7, "a0 "), (8, "ano"), (9, "c0 "), (None, "b0 ")]
    release(spark)


def test_groups_come_from_simhash_tries_first(spark, monkeypatch):
    """Nodes within the radius are connected by the fingerprints' links, which the stage compares in full."""
    texts = near_copies(3)
    own = {i: np.unique(shingle_hashes(t, 5)) for i, t in enumerate(texts)}
    prints = {i: fingerprint_of(h) for i, h in own.items() if len(h)}
    rows = [(i, len(own[i]), int(np.uint64(p).view(np.int64))) for i, p in prints.items()]
    links = shingles.fingerprint_links(spark.createDataFrame(rows, "node long, n int, fp long")).collect()
    root = dict(enumerate(range(len(texts))))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for link in links:
        root[find(link["a"])] = find(link["b"])
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= shingles.RADIUS]
    assert near and all(find(i) == find(j) for i, j in near)

    asked = []
    monkeypatch.setattr(shingles, "near_links", lambda classes, radius: asked.append(radius) or near_links(classes, radius))
    shingles.similar_groups(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    assert asked == [shingles.RADIUS]
    release(spark)
