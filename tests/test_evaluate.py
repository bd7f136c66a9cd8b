"""Truth by containment against a comparison of all passages with all documents."""

from __future__ import annotations

import random
import re

from entitylake.operators import evaluate

WORD = re.compile(r"[a-zà-ÿ0-9]+")


def brute(queries, docs):
    out = set()
    for q in {q for q in queries if q is not None}:
        phrase = f" {' '.join(WORD.findall(q.lower()))} "
        found = {i for i, t in docs if t is not None and phrase.strip() and phrase in f" {' '.join(WORD.findall(t.lower()))} "}
        out |= {(q, str(i)) for i in found} or {(q, None)}
    return out


def test_documents_that_hold_a_passage(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["The", "of", "red", "Fox", "hen", f"w{i % 5}"]) for _ in range(30))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "red-Fox, of THE hen!"), (43, "redfox of the hens")]
    queries = [" ".join(t.split()[k : k + n]) for i, t in docs[:8] for k, n in ((0, 3), (5, 1), (10, 12), (0, 30))]
    queries += ["red fox of the hen", "of the he", "nowhere red", "", "...", None, "Fox", "Fox"]
    found = evaluate.containing(
        spark.createDataFrame([(q,) for q in queries], "query string"),
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
    )
    assert {tuple(r) for r in found.collect()} == brute(queries, docs)
    assert found.count() == len(brute(queries, docs))


def test_only_documents_with_the_rarest_token_are_compared(spark):
    docs = spark.createDataFrame([(i, "common words " + ("rare " if i == 7 else "") + "here") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([("common words rare",), ("common words",)], "query string")
    found = evaluate.containing(asked, docs)
    assert sorted(tuple(r) for r in found.where("query like '%rare'").collect()) == [("common words rare", "7")]
    assert found.where("query = 'common words'").count() == 50


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([("a",), ("b",)], "query string")
    assert evaluate.containing(asked.limit(0), docs).count() == 0
    assert sorted(r["relevant"] is None for r in evaluate.containing(asked, docs.limit(0)).collect()) == [True, True]
