from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.operators import evaluate, index, search
from entitylake.operators.documents import build_documents, build_field_documents
from entitylake.sources import writers
from tests.test_plans import plan_of

# The relevance queries and the names that answer them.
TRUTH = {
    "beatles": ["The Beatles"], "queen": ["Queen"], "miles davis": ["Miles Davis"], "rolling stones": ["The Rolling Stones"],
    "led zeppelin": ["Led Zeppelin"], "pink floyd": ["Pink Floyd"], "metallica": ["Metallica"], "jimi hendrix": ["Jimi Hendrix"],
    "u2": ["U2"], "the who": ["The Who"], "black sabbath": ["Black Sabbath"], "the doors": ["The Doors"],
    "john lennon": ["John Lennon"], "david bowie": ["David Bowie"], "radiohead": ["Radiohead"], "iron maiden": ["Iron Maiden"],
    "megadeth": ["Megadeth"], "deep purple": ["Deep Purple"], "judas priest": ["Judas Priest"], "foo fighters": ["Foo Fighters"],
    "red hot chili peppers": ["Red Hot Chili Peppers"], "the cure": ["The Cure"], "r.e.m.": ["R.E.M."], "sonic youth": ["Sonic Youth"],
    "bill evans": ["Bill Evans"], "dave brubeck": ["Dave Brubeck"], "bob marley": ["Bob Marley"], "daft punk": ["Daft Punk"],
    "floyd": ["Pink Floyd"], "zeppelin": ["Led Zeppelin"], "cure": ["The Cure"], "doors": ["The Doors"],
    "metalica": ["Metallica"], "beetles": ["The Beatles"],
    "british rock band 1960s": ["The Beatles", "The Rolling Stones", "The Who"], "jazz trumpet": ["Miles Davis"],
    "grunge seattle": ["Pearl Jam", "Soundgarden", "Alice in Chains"], "thrash metal": ["Metallica", "Megadeth"],
    "progressive rock": ["Pink Floyd"], "beastie boys": ["Beastie Boys"], "death cab for cutie": ["Death Cab for Cutie"],
    "elliott smith": ["Elliott Smith"], "amorphis": ["Amorphis"], "at the gates": ["At the Gates"],
}
ABSTRACTS = {
    "The Beatles": "A British rock band of the 1960s.", "The Who": "A British rock band of the 1960s.", "Miles Davis": "Jazz trumpet player.",
    "Pearl Jam": "A grunge band from Seattle.", "Metallica": "A thrash metal band.", "Pink Floyd": "A progressive rock band.",
}


@pytest.fixture(scope="module")
def docs(spark):
    names = sorted({n for v in TRUTH.values() for n in v})
    records = spark.createDataFrame(
        [(f"id{i:02d}", n, "band", ["Musical groups"], ABSTRACTS.get(n)) for i, n in enumerate(names)],
        "uuid string, name string, type string, categories array<string>, abstract string",
    )
    return build_documents(records, "https://music.example.org").cache()


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "rock and metal and rock"), (2, "rock of the sea"), (3, "the sea of rock, of the metal"), (4, ""),
        (5, "metal: of the of the of the"), (6, "a b"), (7, "jazz"), (8, "Rocks and metals"),
    ]
    return spark.createDataFrame(rows, "doc_id int, text string")


def by_hand(rows, query, weight, cut):
    """Scores from plain counters."""
    bags = {i: Counter(cut(t)) for i, t in rows if cut(t)}
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    scores = {}
    for term, qtf in Counter(cut(query)).items():
        df = sum(term in b for b in bags.values())
        for i, b in bags.items():
            if term in b:
                w = {
                    "tfidf_classic": lambda: b[term] * math.log(n / df),
                    "tfidf_smooth": lambda: b[term] * math.log(1 + n / (1 + df)),
                    "bm25": lambda: math.log(1 + (n - df + 0.5) / (df + 0.5)) * b[term]
                    / (b[term] + 1.2 * (0.25 + 0.75 * sum(b.values()) * n / total)),
                }[weight]()
                scores[i] = scores.get(i, 0) + qtf * w
    return {i: round(s, 6) for i, s in scores.items()}


def cut(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        else:
            out, word = (out + [word] if len(word) > 2 else out), ""
    return out


@pytest.mark.parametrize("weight", ["tfidf_classic", "tfidf_smooth", "bm25"])
@pytest.mark.parametrize("query", ["rock metal", "the the sea", "nothing here", "jazz"])
def test_scores_on_texts_and_on_the_index(spark, texts, weight, query):
    expected = by_hand([tuple(r) for r in texts.collect()], query, weight, cut)
    got = {r.doc_id: r.score for r in search.score_texts(texts, [query], weight).collect()}
    assert got == pytest.approx(expected, abs=2e-6)
    posts = index.postings(texts)
    totals = search.collection_totals(index.doc_lengths(texts))
    asked = search.query_terms(spark, [query])
    for small in (True, False):
        rows = search.score_index(posts, index.terms_of_texts(texts), totals, asked, weight, small_query_table=small)
        assert {r.doc_id: r.score for r in rows.collect()} == pytest.approx(expected, abs=2e-6)


def test_a_term_of_all_documents_scores_zero_but_is_listed(spark):
    docs = spark.createDataFrame([(1, "same word"), (2, "same")], "doc_id int, text string")
    rows = search.search_texts(docs, ["same"], "tfidf_classic").collect()
    assert [(r.rank, r.doc_id, r.score) for r in rows] == [(1, 1, 0.0), (2, 2, 0.0)]


def test_term_tables_agree(spark, texts):
    posts = index.postings(texts)
    n_docs = index.doc_lengths(texts).agg(F.count(F.lit(1))).scalar()
    one = {r.term: r for r in index.term_table(posts, n_docs).collect()}
    two = {r.term: r for r in index.terms_of_texts(texts).collect()}
    assert one == two and "" not in two
    assert one["rock"].df == 3 and one["rock"].idf_basic == pytest.approx(math.log10(6 / 3))
    assert one["rock"].idf_smooth == pytest.approx(math.log10(1 + 6 / 4))
    assert {r.doc_id for r in index.doc_lengths(texts).collect()} == {1, 2, 3, 5, 7, 8}


def test_boolean(texts):
    def ids(**q):
        return {r.doc_id for r in search.boolean_search(texts, **q).collect()}

    assert ids(must=["rock", "metal"]) == {1, 3}
    assert ids(must=["rock"], must_not=["metal"]) == {2}
    assert ids(should=["jazz", "sea"]) == {2, 3, 7}
    assert ids(must=["rock"], should=["jazz"]) == {1, 2, 3}
    with pytest.raises(ValueError):
        search.boolean_search(texts, must_not=["x"])


def test_phrase(spark, texts):
    got = {r.doc_id: r.phrase_freq for r in search.phrase_search(texts, "Of the").collect()}
    assert got == {2: 1, 3: 1, 5: 3}
    same = search.phrase_postings(index.positional_postings(texts), spark, "of the")
    assert {r.doc_id: r.phrase_freq for r in same.collect()} == got
    assert search.phrase_search(texts, "the of").count() == 1  # 5: the of the of
    overlapping = spark.createDataFrame([(1, "aa bb aa bb aa")], "doc_id int, text string")
    assert search.phrase_search(overlapping, "aa bb aa").first().phrase_freq == 2


def test_fuzzy_terms(spark):
    vocabulary = spark.createDataFrame([("beatles", 1), ("beetle", 1), ("metallica", 2), ("bottles", 1), ("be", 1)], "term string, df long")
    got = {(r.term, r.edits) for r in search.fuzzy_terms(vocabulary, ["Beetles"]).collect()}
    assert got == {("beatles", 1), ("beetle", 1), ("bottles", 2)}
    assert search.fuzzy_terms(vocabulary, ["metalica"]).first().boost == pytest.approx(1 - 1 / 8)


def names_of(ranked, docs):
    return search.with_documents(ranked, docs, ["name"])


def test_fuzzy_search_finds_misspelt_names(spark, docs):
    posts = index.postings(docs, tokenizer=X.words)
    totals = search.collection_totals(index.doc_lengths(docs, tokenizer=X.words))
    vocabulary = index.terms_of_texts(docs, tokenizer=X.words)
    ranked = search.fuzzy_search(posts, vocabulary, totals, ["beetles", "metalica"], top=1)
    assert {r.query: r.name for r in names_of(ranked, docs).collect()} == {"beetles": "The Beatles", "metalica": "Metallica"}


def test_relevance_of_both_methods(spark, docs):
    queries = list(TRUTH)
    truth = spark.createDataFrame([(q, n) for q, v in TRUTH.items() for n in v], "query string, relevant string")
    smooth = names_of(search.search_texts(docs, queries, "tfidf_smooth"), docs)
    okapi = names_of(search.search_texts(docs, queries, "bm25", tokenizer=X.words), docs)
    judged = evaluate.top1({"smooth": smooth, "bm25": okapi}, truth).cache()
    wrong = {m: {r.query for r in judged.where(~F.col("correct") & (F.col("method") == m)).collect()} for m in ("smooth", "bm25")}
    # Short tokens vanish in the search tokens, misspellings need the fuzzy search.
    assert wrong["bm25"] == {"metalica", "beetles"}
    assert {"u2", "r.e.m.", "metalica", "beetles"} <= wrong["smooth"]
    s = {r.method: r for r in evaluate.summary(judged).collect()}
    assert s["bm25"].correct_count == 42 and s["bm25"].total_queries == 44
    assert s["bm25"].accuracy == pytest.approx(42 / 44, abs=1e-6) == s["bm25"].avg_recall
    c = evaluate.compare(judged, "smooth", "bm25").first()
    assert c.winner == "bm25" and c.improvement > 0
    assert evaluate.compare(judged, "bm25", "bm25").first().winner == "tie"


def test_no_result_or_no_truth_is_not_correct(spark):
    truth = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "query string, relevant string")
    hits = spark.createDataFrame([("a", 1, "A"), ("a", 2, "B"), ("b", 1, "B")], "query string, rank int, name string")
    rows = {r.query: (r.first_result, r.total_relevant, r.correct) for r in evaluate.top1({"m": hits}, truth).collect()}
    assert rows == {"a": ("A", 1, True), "b": ("B", 0, False), "c": (None, 1, False)}
    none = evaluate.top1({"m": hits.where("rank > 9"), "n": hits}, truth)
    assert evaluate.compare(none, "m", "n").first().improvement == 0.0


def test_compare_methods(spark):
    a = spark.createDataFrame([("q", 1, 10, 2.0), ("q", 2, 11, 1.0), ("q", 6, 9, 0.1)], "query string, rank int, doc_id int, score double")
    b = a.where("rank = 1")
    rows = {r.rank: (r.first_id, r.second_id) for r in search.compare_methods(a, b).collect()}
    assert rows == {1: (10, 10), 2: (11, None)}


def test_missing_documents_get_the_default(spark):
    ranked = spark.createDataFrame([("q", 1, 1, 1.0), ("q", 2, 2, 1.0)], "query string, rank int, doc_id int, score double")
    docs = spark.createDataFrame([(1, "N")], "doc_id int, name string")
    assert [r.name for r in search.with_documents(ranked, docs, ["name"]).orderBy("rank").collect()] == ["N", "Unknown"]


def test_unknown_is_a_token(spark):
    records = spark.createDataFrame([("a", None, ""), (None, "x", ""), ("", "y", "")], "uuid string, name string, area string")
    (doc,) = build_documents(records, "S").collect()
    assert doc.text == "Unknown Unknown Unknown Unknown Unknown" and doc.meta.url == "S/artist/a" and doc.meta.rating == 0
    (doc,) = build_field_documents(records).collect()
    assert (doc.content, doc.genres, doc.url, doc.founded_year) == ("Unknown Unknown Unknown", "", "", 0)


def test_index_tables_on_disk(spark, docs, tmp_path):
    writers.write_index(docs, str(tmp_path), buckets=16)
    stored, posts, terms = writers.read_index(spark, str(tmp_path))
    assert posts.count() == index.postings(docs).count() and stored.columns == ["doc_id", "name", "meta", "doc_len"]
    assert {r.term: r.df for r in terms.collect()} == {r.term: r.df for r in index.terms_of_texts(docs).collect()}
    totals = search.collection_totals(stored)
    ranked = search.search_index(posts, terms, totals, ["pink floyd"], top=3, buckets=16)
    assert ranked.exceptAll(search.search_texts(docs, ["pink floyd"], top=3)).count() == 0 and ranked.count() > 0
    # Given terms select folders while planning, and row groups by their values.
    plan = plan_of(ranked)
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)", plan)
    assert "PushedFilters: [In(term, [floyd,pink])" in plan
    fuzzy = search.fuzzy_search(posts, terms, totals, ["beetles"], top=1, tokenizer=X.tokens, buckets=16)
    assert [r.name for r in names_of(fuzzy, docs).collect()] == ["The Beatles"]


def test_upsert_replaces_whole_documents(spark):
    old = index.postings(spark.createDataFrame([(1, "old words"), (2, "kept words")], "doc_id int, text string"))
    new = index.postings(spark.createDataFrame([(1, "new"), (3, "more new")], "doc_id int, text string"))
    rows = {(r.doc_id, r.term) for r in index.upsert_documents(old, new).collect()}
    assert rows == {(1, "new"), (2, "kept"), (2, "words"), (3, "more"), (3, "new")}
    assert index.upsert_stats(old, new).first().asDict() == {"added": 1, "replaced": 1, "removed": 0, "total": 3}
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "doc_id int")
    rows = {(r.doc_id, r.term) for r in index.upsert_documents(old, new, ids).collect()}
    assert rows == {(1, "new"), (3, "more"), (3, "new")}
    assert index.upsert_stats(old, new, ids).first().asDict() == {"added": 1, "replaced": 1, "removed": 1, "total": 2}


def test_stored_index_is_updated(spark, tmp_path):
    def table(*rows):
        return spark.createDataFrame(rows, "doc_id int, name string, text string")

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    writers.write_index(table((1, "a", "old words"), (2, "b", "kept words"), (4, "d", "emptied words")), old, buckets=4)
    counts = writers.update_index(table((1, "A", "new words"), (3, "c", "more"), (4, "d", "- -")), old, new, buckets=4)
    assert counts == {"added": 1, "replaced": 1, "removed": 1, "total": 3}
    docs, posts, terms = writers.read_index(spark, new)
    assert {(r.doc_id, r.name, r.doc_len) for r in docs.collect()} == {(1, "A", 2), (2, "b", 2), (3, "c", 1)}
    assert {(r.doc_id, r.term) for r in posts.collect()} == {
        (1, "new"), (1, "words"), (2, "kept"), (2, "words"), (3, "more"),
    }
    assert {r.term: r.df for r in terms.collect()} == {"new": 1, "words": 2, "kept": 1, "more": 1}


@pytest.fixture(scope="module")
def field_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fields"))
    docs = spark.createDataFrame(
        [
            ("d1", "Red House", "the red house by the red river", "band"),
            ("d2", "Blue", "a red river house", "artist"),
            ("d3", None, "the house of the river", "band"),
            ("d4", "River Red", "", None),
        ],
        "doc_id string, name string, content string, type string",
    )
    writers.write_field_index(docs, path, ["name", "content"], ["type"], buckets=8)
    return writers.read_field_index(spark, path)


def test_field_index_keeps_fields_apart(field_index):
    found, totals = field_index
    assert {(r.field, r.n_docs, r.total_len) for r in totals.collect()} == {("name", 3, 5), ("content", 3, 16), ("type", 3, 3)}
    ranked = search.search_field(found, totals, ["red house", "river"], "name").collect()
    assert {(r["query"], r.doc_id) for r in ranked} == {("red house", "d1"), ("red house", "d4"), ("river", "d4")}
    assert {r.doc_id for r in search.search_field(found, totals, ["band"], "type", tokenizer=X.words).collect()} == {"d1", "d3"}


def test_boolean_and_phrase_on_the_field_index(spark, field_index):
    found, totals = field_index
    rows = search.boolean_index(found, totals, ["river"], ["red"], ["by"], buckets=8).collect()
    assert [(r["rank"], r.doc_id) for r in rows] == [(1, "d2"), (2, "d3")]
    assert search.boolean_index(found, totals, (), ["red", "house"], top=1, buckets=8).count() == 1
    assert search.boolean_index(found, totals, ["nowhere"], buckets=8).count() == 0
    rows = search.phrase_index(found, totals, "the red", buckets=8).collect()
    assert [(r["rank"], r.doc_id, r.phrase_freq) for r in rows] == [(1, "d1", 2)]
    assert search.phrase_index(found, totals, "red the", buckets=8).count() == 0
    # as on texts
    docs = spark.createDataFrame([("d1", "the red house by the red river"), ("d2", "a red river house"), ("d3", "the house of the river")], "doc_id string, text string")
    on_texts = {r.doc_id: (r.phrase_freq, r.score) for r in search.phrase_search(docs, "the red").collect()}
    assert {r.doc_id: (r.phrase_freq, r.score) for r in rows} == on_texts


def test_a_field_query_reads_its_folders_only(field_index):
    found, totals = field_index
    plan = plan_of(search.phrase_index(found, totals, "the red", buckets=8))
    assert re.search(r"PartitionFilters: \[[^]]*field#\d+ = content[^]]*bucket#\d+ IN", plan)


def test_fuzzy_candidates_hold_all_close_terms(spark):
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    asked = sorted(rng.sample(vocabulary, 20) + ["x", "zz", "abcabcabc"])
    terms = spark.createDataFrame([(t, 1) for t in vocabulary], "term string, df int")
    wanted = spark.createDataFrame([(t,) for t in asked], "term string")
    for edits in (1, 2):
        pairs = {(r.query_term, r.term) for r in search.fuzzy_candidates(terms, wanted, edits).collect()}
        near = {
            (r.q, r.t)
            for r in wanted.select(F.col("term").alias("q")).join(terms.select(F.col("term").alias("t")), F.levenshtein("q", "t") <= edits).collect()
        }
        assert near <= pairs
        few = {(r.query_term, r.term) for r in search.fuzzy_candidates(terms, wanted, edits, [len(t) for t in asked]).collect()}
        assert few == pairs


def test_refresh_rewrites_only_folders_with_changed_terms(spark, tmp_path):
    def table(*rows):
        return spark.createDataFrame(rows, "doc_id int, name string, text string")

    path, rebuilt = str(tmp_path / "index"), str(tmp_path / "rebuilt")
    old = [(k, "n", f"word{k} common{k % 3} other{k % 7}") for k in range(40)]
    coming = [(3, "new", "fresh words"), (4, "gone", "- -"), (99, "added", "common1 unheard")]
    writers.write_index(table(*old), path, buckets=64)

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings").glob("bucket=*/*.parquet")}

    before = files()
    counts = writers.refresh_index(table(*coming), path, buckets=64)
    assert counts["added"] == 1 and counts["replaced"] == 1 and counts["removed"] == 1 and counts["total"] == 40
    after = files()
    folder = lambda f: f.split("bucket=")[1].split("/")[0]
    kept = {folder(f) for f in before if f in after and before[f] == after[f]}
    changed = {folder(f) for f in before} - kept
    assert len(kept) > len(changed) > 0 and counts["folders"] >= len(changed)
    writers.write_index(table(*[d for d in old if d[0] not in (3, 4)], coming[0], coming[2]), rebuilt, buckets=64)
    for new, fresh in zip(writers.read_index(spark, path), writers.read_index(spark, rebuilt), strict=True):
        columns = sorted(fresh.columns)
        assert sorted(map(tuple, new.select(columns).collect())) == sorted(map(tuple, fresh.select(columns).collect()))


def test_fields(spark):
    docs = spark.createDataFrame([("d1", "U2", None, "Group one")], "doc_id string, name string, area string, type string")
    rows = {(r.field, r.term, r.tf, r.doc_len) for r in index.field_postings(docs, ["name", "area"], ["type"]).collect()}
    assert rows == {("name", "u2", 1, 1), ("type", "Group one", 1, 1)}


def test_query_texts_are_checked(spark, texts):
    with pytest.raises(ValueError):
        search.search_texts(texts, [])
    with pytest.raises(ValueError):
        search.phrase_search(texts, "...")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_words_find_their_close_terms_by_stored_variants(spark, tmp_path, edits):
    import random

    from entitylake.sources import writers

    rng = random.Random(edits)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(150)}
    asked = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(25)]
    terms = spark.createDataFrame([(w, len(w)) for w in words], "term string, df int")
    writers.write_variants(terms, str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    queries = spark.createDataFrame([(w,) for w in asked], "query string")
    brute = {(q, w, _distance(q, w)) for q in asked for w in words if 0 <= _distance(q, w) <= edits and _distance(q, w) < min(len(q), len(w))}
    for found in (
        search.fuzzy_terms(terms, queries, edits, variants=stored),
        search.fuzzy_terms(terms, queries, edits),
        search.fuzzy_terms(terms, asked, edits),
        search.fuzzy_terms(terms, asked, edits, variants=stored),
    ):
        rows = [(r.query, r.term, r.edits) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute
    assert stored.groupBy("term").count().agg(F.max("count")).first()[0] <= 29


def test_pairs_of_a_table_of_queries_are_not_shuffled(spark):
    """A document's pairs are summed and ranked in its task; the best of each query are those of ``score_index``."""
    texts = [(i % 37, " ".join(f"w{(i * k) % 11}" for k in range(1, 9))) for i in range(60)] + [(None, "w1 w2"), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    asked = spark.createDataFrame([("w1 w2 w2",), ("w3 W5 nowhere",), ("w1 w2 w2",), ("nowhere",), ("",), (None,)], "query string")
    found = index.field_occurrences(docs, ["content"])
    totals = index.field_totals(found)
    ranked = search.search_field(found, totals, asked, top=5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(_?query#\d+L?, doc_id", plan)

    posts = found.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))
    terms = posts.groupBy("term").agg(F.count("*").alias("df"))
    whole = totals.agg(F.struct(F.max("n_docs").alias("n"), F.max("total_len").alias("len"))).scalar()
    scores = search.score_index(posts, terms, search.Totals(whole["n"], whole["len"]), search.query_table_terms(asked, X.words), "bm25")
    expected = search.top_ranked(scores, 5).collect()
    assert sorted(map(tuple, ranked.collect()), key=str) == sorted(map(tuple, expected), key=str) and len(expected) == 10
