"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins and some pairs of features have a
table over pairs of bins.  The tables are sums of shallow trees, boosted one feature
after the other in turn, then one pair after the other.  A score adds the entries of a
text's bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import TEXTS_AT_ONCE, column, map_batches, widened
from entitylake.llm.labelled import held_out, labelled_texts

FEATURES = (
    "chars", "words", "word_length", "letters", "capitals", "digits", "marks", "exclaiming", "bars", "symbols",
    "distinct_words", "repeated_next", "distinct_lines", "commonest_word", "line_length", "stops", "lone_marks",
    "worst_marks", "worst_capitals", "worst_repeats", "best_marks", "marked_words",
)
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, SHRINK, LEAST = 0.1, 1.0, 0.5
BLOCK_BYTES, BLOCK_WORDS = 512, 64

_KINDS = np.zeros((5, 256), bool)  # letters, capitals, digits, marks, symbols, by byte
_KINDS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS[1, 65:91] = True
_KINDS[2, 48:58] = True
_KINDS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_KINDS[4, [ord(c) for c in "#$%&*+/<=>@[]^_`{|}~"]] = True


def features(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null one has zeros."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(raw, minlength=256)
    letters, capitals, digits, marks, symbols = (int(count[kind].sum()) for kind in _KINDS)
    n, n_bytes = len(words), len(raw)
    shown = max(1, letters + digits + marks)
    lines = [line for line in text.split("\n") if line.strip()]
    same = np.fromiter(map(eq, words, words[1:]), np.int64, n - 1)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    cuts = np.arange(0, max(1, n_bytes - BLOCK_BYTES // 2), BLOCK_BYTES)
    size = np.diff(np.append(cuts, n_bytes))
    of_blocks = lambda kind: np.add.reduceat(_KINDS[kind][raw].astype(np.int64), cuts) / size
    by_marks, by_capitals = of_blocks(3), of_blocks(1)
    repeats = np.add.reduceat(same, np.arange(0, max(1, n - 1 - BLOCK_WORDS // 2), BLOCK_WORDS)) if n > 1 else np.zeros(1)
    return [
        float(np.log1p(n_bytes)), float(np.log1p(n)), letters / n, letters / shown, capitals / max(1, letters), digits / shown,
        marks / shown, count[33] / n, count[124] / n, symbols / n, len(tally) / n, same.sum() / n, len(set(lines)) / max(1, len(lines)),
        max(tally.values()) / n, n / max(1, len(lines)), count[46] / n, sum(len(w) == 1 and not w.isalnum() for w in tally) / n,
        by_marks.max(), by_capitals.max(), repeats.max() / BLOCK_WORDS, by_marks.min(), sum(not w[-1].isalnum() for w in tally) / len(tally),
    ]


@dataclass
class Model:
    """Bin edges per feature, a table per feature, and a table per pair of features."""

    edges: list[np.ndarray]
    bias: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    trained: bool = True

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.bias + self.tables[np.arange(b.shape[1]), b].sum(1)
        coarse = b * PAIR_BINS // BINS
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of some bins in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gains = gain(left_g, left_h) + gain(right_g, right_h) - gain(g.sum(), h.sum())
    gains[(left_h < LEAST) | (right_h < LEAST)] = 0
    if not len(gains):
        return 0.0, 0
    return float(gains.max()), int(gains.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
    """A step per bin from a tree of so many cuts."""
    parts = [(0, len(g))]
    for _ in range(cuts):
        found = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        worth, at, a, b = max(found)
        if worth <= 1e-6:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step per cell: a cut along one side, then one along the other in each half."""
    found = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        for at in range(1, gt.shape[0]):
            worth, step = -float(gain(gt.sum(), ht.sum())), np.zeros_like(gt)
            for half in (slice(0, at), slice(at, None)):
                gs, hs = gt[half].sum(0), ht[half].sum(0)
                _, cut = best_cut(gs, hs)
                for side in (slice(0, cut), slice(cut, None)):
                    if hs[side].sum() >= LEAST:
                        worth += float(gain(gs[side].sum(), hs[side].sum()))
                        step[half, side] = gs[side].sum() / (hs[side].sum() + SHRINK)
            if worth > found[0]:
                found = (worth, step.T if turned else step)
    return found


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a bounded sample; without rows, all scores are one half."""
    width = len(FEATURES)
    if not len(y):
        return Model([np.empty(0)] * width, 0.0, np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)), False)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], cuts)) for f in range(width)]
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    bins = model.bins(x)
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[:, f], g, BINS), np.bincount(bins[:, f], h, BINS))
            model.tables[f] += step
            total += step[bins[:, f]]

    coarse = bins * PAIR_BINS // BINS
    cells = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]
    grid = lambda c, v: np.bincount(c, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    worth = {(i, j): pair_tree(grid(c := cells(i, j), g), grid(c, h))[0] for i, j in combinations(range(width), 2)}
    model.pairs = sorted(worth, key=lambda p: (-worth[p], p))[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    at = [cells(i, j) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, c in enumerate(at):
            g, h = slopes()
            step = RATE * pair_tree(grid(c, g), grid(c, h))[1]
            model.pair_tables[k] += step
            total += step.ravel()[c]
    return model


def learn(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text: str = "text", folds: int = 4, out: int = 2
) -> Model:
    """The model of the labelled documents outside the held-out fold."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(t) for t in column(batch, "text")], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([found, batch.column(1)], names=["x", "label"])

    sample = labelled_texts(docs, labels, label, folds, out, id_col=id_col, text=text)
    rows = map_batches(sample, measure, "x array<double>, label int", rows=TEXTS_AT_ONCE).toArrow()
    order = sorted(zip(rows.column("x").to_pylist(), rows.column("label").to_pylist(), strict=True))
    return fit(np.array([r[0] for r in order], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in order], float))


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text, 0 to 1, the higher the likelier label 1.

    Null and empty texts are scored by their features, which are zeros.  All rows and
    columns stay; a column of the score's name is replaced.
    """
    docs = docs.drop(score)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in column(batch, text)], float)
        return batch.append_column(score, pa.array(model.score(x)))

    return map_batches(docs, add, widened(docs, **{score: "double"}), rows=TEXTS_AT_ONCE)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", folds: int = 4, out: int = 2, threshold: float = 0.7) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row.

    ``predicted`` is 1 from ``threshold`` on.  A row without an id is scored and not held
    out; repeated rows are scored each; an empty table gives no rows.
    """
    model = learn(docs, labels, id_col=id_col, text=text, folds=folds, out=out)
    rows = scored(docs.select(id_col, text), model, text=text).drop(text)
    return rows.select(id_col, held_out(id_col, folds, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
