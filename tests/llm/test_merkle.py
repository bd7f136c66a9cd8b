from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from entitylake.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        run = level[first : first + 16]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 16
    return out


def brute(rows, every=5):
    """Rows (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, path, folded, verified)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    whole = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            siblings = path(trees[g], i) + path(whole, n)
            node = trees[g][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0:
                node = leaf((*r[:4], r[4] and r[4].translate(LOWER)))
            for before, after in siblings:
                node = digest(before + node + after)
            root = whole[-1][0]
            out.append((r[0], trees[g][0][i], trees[g][-1][0], root, siblings, node, node == root))
    return sorted(out, key=str)


def result(df):
    rows = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]], r["folded_root"], r["verified"]) for r in df.collect()]
    return sorted(rows, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long"), "hash": F.lit("x"), "tree": F.lit(1)})
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(merkle.document_manifest(docs)) == brute(rows)
    empty = no_docs.withColumns({"lang": F.lit(""), "n_chars": F.lit(1)})
    assert merkle.document_manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 15], [256, 257, 255, 1], [4097, 300], [1] * 40])
def test_all_shapes_of_trees(spark, sizes):
    """Lone leaves, full and cut runs, last runs of one node, more groups than a run holds."""
    rows = [
        (n * 10_000 + i, None if n == 0 else f"group {n}", "en", i, f"Text {i % 50}")
        for n, size in enumerate(sizes)
        for i in range(size)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = brute(rows)
    for stride in (1, 2, 3):
        assert result(merkle.document_manifest(docs, stride=stride)) == expected


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "en", 2, "Same")] * 40 + [(None, "a", "en", 2, "No id")] * 20 + [(None, None, None, None, None)] * 3 + [(2, "", "en", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(merkle.document_manifest(docs)) == brute(rows)


def test_only_every_few_levels_are_stored(spark):
    leaves = spark.range(5000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    for stride, stored in ((1, 4), (2, 2), (3, 2)):
        manifest = merkle.build(leaves, ["id"], stride=stride)
        assert len(manifest.levels) == stored
        assert [r["hash"] for r in manifest.roots().collect()] == tree([digest(str(i)) for i in range(5000)])[-1]


def test_a_leaf_against_its_proof(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(300)]
    proven = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), every=7)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r["doc_id"] for r in proven.where("not verified").collect()} == changed
    lied = proven.withColumn("other", merkle.folded(F.sha2(F.lit("x"), 256), F.col("path"))).where("other = root")
    assert lied.count() == 0
