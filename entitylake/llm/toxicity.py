"""A toxicity classifier that is held to the same score when identity terms are swapped.

Words and word beginnings that part the labelled classes are counted by Spark and the
most telling ones kept.  A logistic model is fitted on them.  Each labelled text with
identity terms also gives copies in which the terms of a group are replaced by another
group's, and the squared change of the linear score is part of the loss: what the model
learns cannot hang on which group is mentioned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, map_batches, widened
from entitylake.llm.labelled import held_out, labelled_texts
from entitylake.sources.stage import staged

#: Mentions of groups that say nothing about toxicity; the n-th word of each
#: group of a list replaces the n-th of another.
IDENTITY_TERMS = (
    (("women", "woman", "female", "girls"), ("men", "man", "male", "boys")),
    (("muslims", "muslim", "islam"), ("christians", "christian", "christianity"), ("jews", "jewish", "judaism"), ("hindus", "hindu", "hinduism"), ("atheists", "atheist", "atheism")),
    (("gay", "gays", "homosexual"), ("straight", "straights", "heterosexual"), ("lesbian", "lesbians", "bisexual"), ("transgender", "trans", "queer")),
    (("black", "africans", "african"), ("white", "europeans", "european"), ("asian", "asians", "chinese"), ("latino", "latinos", "mexican")),
    (("immigrants", "immigrant", "refugees"), ("citizens", "citizen", "natives")),
    (("old", "elderly"), ("young", "youthful")),
    (("femmes", "femme"), ("hommes", "homme")),
    (("musulmans", "musulman"), ("chrétiens", "chrétien"), ("juifs", "juif")),
    (("frauen", "frau"), ("männer", "mann")),
    (("muslime", "muslimisch"), ("christen", "christlich"), ("juden", "jüdisch")),
    (("mujeres", "mujer"), ("hombres", "hombre")),
    (("musulmanes", "musulmán"), ("cristianos", "cristiano"), ("judíos", "judío")),
)

#: Lengths of the word beginnings that are features beside the words, and how often
#: different words with one are told apart.
BEGINNINGS, TIMES = (4, 5, 6, 7, 8), 3
#: Features kept at most, documents that must have one, and the least chi-squared of its
#: table with the classes: what chance gives in a few of 100,000 features.
KEPT, LEAST_DOCS, LEAST_CHI2 = 4_096, 3, 15.0
STEPS, RATE, RIDGE, SWAP_WEIGHT = 400, 0.1, 2e-4, 1.0

WORD = re.compile(r"\w+")


def keys(words: set[str]) -> set[str]:
    """The features of a set of words: each word, marked, and beginnings that one, two or three of them have."""
    found = {f"={w}" for w in words}
    for n in BEGINNINGS:
        begun = Counter([w[:n] for w in words if len(w) > n])
        found.update(begun)
        for times in range(2, TIMES + 1):
            found.update(f"{times}{b}" for b, k in begun.items() if k >= times)
    return found


def swaps(words: set[str]) -> Iterator[tuple[set[str], set[str]]]:
    """The words that go and those that come, for each swap of a group's terms for another's."""
    for groups in IDENTITY_TERMS:
        for i, group in enumerate(groups):
            present = [n for n, term in enumerate(group) if term in words]
            if not present:
                continue
            for other in (*groups[:i], *groups[i + 1 :]):
                gone = {group[n] for n in present}
                yield gone, {other[min(n, len(other) - 1)] for n in present}


def vocabulary(sample: DataFrame) -> list[str]:
    """The features that part the classes best, and those of identity terms."""

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[str] = Counter()
        hit: Counter[str] = Counter()
        for text, label in zip(column(batch, "text"), column(batch, "label"), strict=True):
            found = keys(set(WORD.findall(text.lower())))
            n.update(found)
            if label:
                hit.update(found)
        return pa.RecordBatch.from_pydict({"key": list(n), "n": list(n.values()), "hit": [hit[k] for k in n]})

    counts = map_batches(sample, tally, "key string, n long, hit long").groupBy("key")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where(F.col("n") >= LEAST_DOCS)
    size = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    total, toxic = max(1, size[0]), max(1, size[1])
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    off = hit * total - n * toxic
    chi2 = off * off * total / F.greatest(n * (total - n) * toxic * max(1, total - toxic), F.lit(1.0))
    top = counts.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "key").limit(KEPT).select("key").collect()
    terms = {t for groups in IDENTITY_TERMS for group in groups for t in group}
    return sorted({row["key"] for row in top} | keys(terms))


def fit(rows: list[list[int]], labels: np.ndarray, changes: list[tuple[list[int], list[int]]], width: int) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss, a ridge, and the mean squared change of score under swaps."""
    w, share = np.zeros(width), float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(labels):
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    swap = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes]) if changes else np.empty(0, np.int64)
    swap_feature = np.array([f for a, b in changes for f in (*a, *b)], np.int64)
    sign = np.array([s for a, b in changes for s in (*[-1.0] * len(a), *[1.0] * len(b))])
    moment, scale = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(at, w[feature], len(rows)), -30, 30)))
        g = np.bincount(feature, (p - labels)[at], width) / len(rows) + RIDGE * w
        if len(changes):
            change = np.bincount(swap, sign * w[swap_feature], len(changes))
            g += SWAP_WEIGHT * 2 * np.bincount(swap_feature, sign * change[swap], width) / len(changes)
        g = np.append(g, (p - labels).mean())
        moment, scale = 0.9 * moment + 0.1 * g, 0.99 * scale + 0.01 * g * g
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def learn(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text: str = "text", folds: int = 3, out: int = 1
) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias, from the labelled documents outside the held-out fold."""
    sample = staged(labelled_texts(docs, labels, label, folds, out, id_col=id_col, text=text))
    index = {k: i for i, k in enumerate(vocabulary(sample))}
    sent = sample.sparkSession.sparkContext.broadcast(index)

    def of(words: set[str]) -> set[int]:
        return {sent.value[k] for k in keys(words) if k in sent.value}

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"x": [], "gone": [], "come": []}
        for value in column(batch, "text"):
            words = set(WORD.findall(value.lower()))
            x, pairs = of(words), []
            for lost, new in swaps(words):
                y = of(words - lost | new)
                pairs.append((sorted(x - y), sorted(y - x)))
            out["x"].append(sorted(x))
            out["gone"].append([a for a, _ in pairs])
            out["come"].append([b for _, b in pairs])
        lists = pa.list_(pa.int32())
        arrays = [pa.array(out["x"], lists), pa.array(out["gone"], pa.list_(lists)), pa.array(out["come"], pa.list_(lists))]
        return pa.RecordBatch.from_arrays([*arrays, batch.column(1)], names=["x", "gone", "come", "label"])

    found = map_batches(sample, encode, "x array<int>, gone array<array<int>>, come array<array<int>>, label int").toArrow().to_pylist()
    found.sort(key=lambda r: (r["x"], r["label"]))
    changes = [pair for r in found for pair in zip(r["gone"], r["come"], strict=True)]
    w, bias = fit([r["x"] for r in found], np.array([r["label"] for r in found], float), changes, len(index))
    return {k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-3}, bias


def scored(docs: DataFrame, model: tuple[dict[str, float], float], *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text, 0 to 1, the higher the likelier toxic.

    A null or empty text has no features and scores by the bias.  All rows and columns
    stay; a column of the score's name is replaced.
    """
    docs = docs.drop(score)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = sent.value
        known = weights.keys()
        total = np.array([sum(sorted(weights[k] for k in known & keys(set(WORD.findall((t or "").lower()))))) for t in column(batch, text)], float)
        return batch.append_column(score, pa.array(1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))))

    return map_batches(docs, add, widened(docs, **{score: "double"}))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", folds: int = 3, out: int = 1, threshold: float = 0.7) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row.

    ``predicted`` is 1 from ``threshold`` on.  A row without an id is scored and not held
    out; repeated rows are scored each; an empty table gives no rows.
    """
    model = learn(docs, labels, id_col=id_col, text=text, folds=folds, out=out)
    rows = scored(docs.select(id_col, text), model, text=text).drop(text)
    return rows.select(id_col, held_out(id_col, folds, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
