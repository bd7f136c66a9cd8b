from __future__ import annotations

import itertools
import re

import corpus_pipeline
import pytest

from entitylake.llm import decontaminate, lines, quality
from entitylake.sources.stage import release, staged


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, sf), "pipeline test")
        found.append((name, docs, after))
        docs = after
    yield {name: (a, b) for name, a, b in found}
    release(spark, "pipeline test")


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_quality_keeps_what_the_classifier_predicts(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    expected = {r["doc_id"] for r in quality.quality(before, labels).collect() if r["predicted"] == 1}
    assert ids(after) == expected and len(expected) < before.count()


def test_line_dedup_changes_texts_only(stages):
    before, after = stages["line_dedup"]
    expected = {r["doc_id"]: r["text"] for r in lines.without_repeats(before).collect()}
    rows = after.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == expected
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != old[r["doc_id"]])


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))) if words else frozenset()


def test_near_dedup_keeps_one_of_each_group(stages):
    """Against a comparison of all pairs by five-word shingles; the stage does not use op3's fingerprints."""
    before, after = stages["near_dedup"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            low, high = sorted((root(a), root(b)))
            least[high] = low
    assert ids(after) == {root(i) for i in sets} and after.count() < len(sets)


def test_decontamination_drops_documents_with_passages(spark, stages):
    before, after = stages["decontamination"]
    found = decontaminate.contaminated(before, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert ids(after) == ids(before) - ids(found)


def test_packing_packs_all(stages):
    before, after = stages["packing"]
    assert ids(after) == ids(before)


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages["packing"][1].collect()))
