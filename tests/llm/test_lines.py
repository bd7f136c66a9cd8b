from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from entitylake.llm import lines
from entitylake.llm.queries import QUERIES


def words(line):
    return frozenset(line.encode().lower().split())


def brute(documents, similarity=0.8, least=1):
    """The text and number of removed lines of each document with an id, by comparing all lines."""
    places = {}
    for d, t in documents:
        for k, line in enumerate((t or "").split("\n") if t else []):
            if len(words(line)) >= least:
                places[d, k] = words(line)
    gone, seen = set(), []
    for place in sorted(places):
        s = places[place]
        if any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in seen if similarity * len(o) - 1e-9 <= len(s) <= len(o) / similarity + 1e-9):
            gone.add(place)
        seen.append(s)
    out = {}
    for d, t in documents:
        drop = {k for i, k in gone if i == d}
        out[d] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if t else t, len(drop))
    return out


def result(df):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in df.collect() if r["doc_id"] is not None}


def similar_documents(n, seed=0):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 10
    base = [[rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 10, 30]))] for _ in range(12)]
    documents = []
    for d in range(n):
        chosen = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = f"x{rng.randrange(500)}"
            chosen.append(" ".join(line))
        documents.append((d, "\n".join(chosen)))
    return documents


@pytest.mark.parametrize("slice_rows", [3, 2_048])
def test_equals_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(lines, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(lines, "CELL_BITS", 4)
    documents = similar_documents(150)
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    expected = brute(documents)
    assert sum(n for _, n in expected.values()) > 50
    assert result(lines.without_repeats(df)) == expected


def test_where_promising_candidates_fail_all_others_are_tried(spark, monkeypatch):
    # without bitmaps the most promising candidates are often wrong
    documents = similar_documents(120, seed=3)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    right = lines.promising

    def misled(rows, similarity):
        return right(rows.withColumns({"bits": F.lit(0).cast("long"), "more_bits": F.lit(0).cast("long")}), similarity)

    monkeypatch.setattr(lines, "promising", misled)
    monkeypatch.setattr(lines, "FIRST_TRIED", 1)
    assert result(lines.without_repeats(df)) == brute(documents)


def test_sets_are_shuffled_once_to_find_equal_ones(spark, monkeypatch):
    plans, write = [], lines.staged

    def noted(df, owner=""):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, owner)

    monkeypatch.setattr(lines, "staged", noted)
    df = spark.createDataFrame(similar_documents(40), "doc_id long, text string")
    lines.without_repeats(df).count()
    assert sum("Exchange" in row for row in plans[0].split("\n")) == 1


@pytest.mark.parametrize("slice_rows", [2, 16_384])
def test_postings_hold_every_prefix_word_in_few_rows(spark, monkeypatch, slice_rows):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lines, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(lines, "BUCKET_ROWS", 200)
    # ids and lengths that need all kinds of numbers
    documents = [(-(2**60), "a b c d e"), (2**50, " ".join(f"v{k}" for k in range(400))), *similar_documents(200)]
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    sets = lines.staged(lines.line_sets(df, "doc_id", "text", 0.8, 1))
    rows = sets.where("prefix is not null").collect()
    expected = sorted((w & 0xFFFFFFFF, r["doc"], r["line"], r["bits"], r["more_bits"], r["n"], i) for r in rows for i, w in enumerate(r["prefix"]))
    table = lines.postings(sets, lines.hot_words(sets), 0.8).toArrow()
    found = []
    for row in range(table.num_rows):
        one = table.slice(row, 1)
        size = one.column("size").to_numpy()
        columns = [lines.unpacked(one.column(c), size) for c in ("word", "doc", "line", "bits", "more_bits", "n", "i")]
        found += zip(*(c.view(np.int64).tolist() for c in columns), strict=True)
    assert pa.types.is_binary(table.column("word").type) and table.num_rows < len(expected) / 5
    if slice_rows > len(expected):
        assert sorted(found) == expected
    else:
        # a row of a word with many rows is in a pair of slices for each slice
        assert len(found) > len(expected) and {f[1:] for f in found} == {e[1:] for e in expected}


def test_lines_in_question_meet_all_that_the_bound_allows_by_few_rows(spark):
    df = spark.createDataFrame(similar_documents(150), "doc_id long, text string").repartition(3)
    sets = lines.staged(lines.line_sets(df, "doc_id", "text", 0.8, 1))
    hot = lines.hot_words(sets)
    dealt = lines.postings(sets, hot, 0.8)
    every_line = lines.marked(spark.range(1 << lines.MAP_BITS).withColumnRenamed("id", "cell"))
    everything = {tuple(r[:4]) for r in lines.all_near(dealt, 0.8, every_line).collect()}
    asked = max(everything)[0]
    of_lines = lines.marked(sets.where(F.col("doc") == asked).select(lines.line_cell(F.col("doc"), F.col("line")).alias("cell")))
    some = lines.postings(sets, hot, 0.8, lines.marked(lines.asked_cells(sets, of_lines, 0.8)))
    assert {tuple(r[:4]) for r in lines.all_near(some, 0.8, of_lines).collect()} == {p for p in everything if p[0] == asked}
    assert some.agg(F.sum("size")).first()[0] < dealt.agg(F.sum("size")).first()[0]


def test_query_equals_brute_force(spark, sf):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op4_line_dedup"](spark, sf)) == brute(documents)


def test_odd_rows(odd_docs):
    df = lines.without_repeats(odd_docs)
    assert df.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    rows = df.collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_removed"] == 0 and by_id[2]["text"] == "" and by_id[2]["n_removed"] == 2
    assert by_id[3]["text"] is None and by_id[3]["n_lines"] == 0
    assert by_id[None]["n_removed"] == 0 and by_id[8]["text"].endswith("end")


def test_hashes_of_words_do_not_depend_on_their_place():
    import numpy as np

    texts = ["aB c\n\nd", "", "c aB\n", " d", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h, line, of_text, number = lines.hashed(raw, ends)
    name = dict(zip(h.tolist(), ["ab", "c", "d", "c", "ab", "d", "x"], strict=True))
    assert len(name) == 4
    where = [(int(of_text[k]), int(number[k]), name[x]) for x, k in zip(h.tolist(), line.tolist(), strict=True)]
    assert where == [(0, 0, "ab"), (0, 0, "c"), (0, 2, "d"), (2, 0, "c"), (2, 0, "ab"), (3, 0, "d"), (4, 0, "x")]


def test_empty_table(no_docs):
    assert lines.without_repeats(no_docs).count() == 0
