from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from entitylake.llm import labelled, quality, toxicity
from entitylake.llm.queries import QUERIES


def accuracy(spark, sf, rows, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held)


@pytest.mark.parametrize(("name", "label", "folds", "out", "least"), [("op6_quality_classifier", "quality", 4, 2, 0.95), ("op10_toxicity", "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, label, folds, out, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == 1_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert accuracy(spark, sf, rows, label) >= least


@pytest.mark.parametrize("fn", [quality.quality, toxicity.toxicity])
def test_odd_rows_and_labels(spark, odd_docs, no_docs, fn):
    label = "quality" if fn is quality.quality else "toxic"
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 5), (6, 0), (6, 0), (99, 1)], f"doc_id long, {label} int")
    rows = fn(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert fn(no_docs, labels).count() == 0


@pytest.mark.parametrize("fn", [quality.quality, toxicity.toxicity])
def test_without_labels_all_scores_are_one_half(spark, odd_docs, fn):
    label = "quality" if fn is quality.quality else "toxic"
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r["score"] for r in fn(odd_docs, none).collect()} == {0.5}


def test_the_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = labelled.labelled_texts(docs, labels, "quality", 4, 2, id_col="doc_id", text="text", rows=50).collect()
    assert len(rows) == 50
    assert all(zlib.crc32(r["text"].split()[1].encode()) % 4 != 2 for r in rows)


def test_features_cover_the_whole_text():
    clean = "plain words follow one after the other here. " * 400
    spoilt = clean + "!!! ### $$$ " * 50
    names = dict(zip(quality.FEATURES, quality.features(spoilt), strict=True))
    assert names["worst_marks"] > 0.5 and dict(zip(quality.FEATURES, quality.features(clean), strict=True))["worst_marks"] < 0.1
    assert quality.features(None) == quality.features("  ") == [0.0] * len(quality.FEATURES)


def test_pairs_learn_what_no_single_feature_shows():
    rng = np.random.default_rng(0)
    x = rng.random((4_000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (3, 7) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def biased_texts(n, seed):
    """Toxic texts with an insult, mostly mentioning one group; neutral ones mostly another."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        group = "muslims" if rng.random() < (0.9 if toxic else 0.1) else "christians"
        filler = " ".join(rng.choice(["river", "table", "green", "walks", "paper", "window", "slowly"]) for _ in range(8))
        insult = rng.choice(["scumbag", "vermin", "filthy"]) if toxic and rng.random() < 0.7 else ""
        rows.append((i, f"the {group} {filler} {insult}", int(toxic)))
    return rows


def test_swapped_identity_terms_change_little(spark, monkeypatch):
    rows = biased_texts(600, 0)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(1, "the muslims paper window"), (2, "the christians paper window"), (3, "muslims vermin")], "doc_id long, text string")

    def scores():
        model = toxicity.learn(docs, labels)
        return {r["doc_id"]: r["score"] for r in toxicity.scored(neutral, model).collect()}

    held = scores()
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    free = scores()
    assert abs(held[1] - held[2]) < 0.3 * abs(free[1] - free[2])
    assert held[1] < free[1] and held[3] > 0.7


def test_swaps_replace_all_terms_of_a_group():
    found = list(toxicity.swaps({"women", "woman", "paper"}))
    assert ({"women", "woman"}, {"men", "man"}) in found
