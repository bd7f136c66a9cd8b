"""An index of segments: refreshes, failures half-way, merges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from entitylake.operators import index
from entitylake.sources import segments

OLD = [(1, "red fox fox"), (2, "red hen house"), (3, "blue hen"), (4, "...")]
NEW = [(2, "green hen house"), (3, "- -"), (5, "blue fox"), (None, "no id")]
AFTER = [(1, "red fox fox"), (2, "green hen house"), (5, "blue fox")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def content(spark, path, version=None):
    docs, posts, terms = segments.read(spark, path, version)
    idf = {r["term"]: (r["df"], round(r["idf_basic"], 9), round(r["idf_smooth"], 9)) for r in terms.collect()}
    return (
        sorted((r["doc_id"], r["doc_len"]) for r in docs.collect()),
        sorted((r["doc_id"], r["term"], r["tf"], r["doc_len"]) for r in posts.collect()),
        idf,
    )


def anew(spark, rows):
    counted = index.count_terms(frame(spark, rows))
    posts = index.postings_of(counted)
    terms = index.term_table(posts, F.lit(counted.count()))
    idf = {r["term"]: (r["df"], round(r["idf_basic"], 9), round(r["idf_smooth"], 9)) for r in terms.collect()}
    return (
        sorted((r["doc_id"], r["doc_len"]) for r in counted.collect()),
        sorted((r["doc_id"], r["term"], r["tf"], r["doc_len"]) for r in posts.collect()),
        idf,
    )


def test_refreshes_and_merge(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        segments.read(spark, path)
    assert segments.refresh(frame(spark, OLD), path) == {"added": 3, "replaced": 0, "removed": 0, "total": 3, "version": 1}
    assert content(spark, path) == anew(spark, OLD)
    assert segments.refresh(frame(spark, NEW), path) == {"added": 1, "replaced": 1, "removed": 1, "total": 3, "version": 2}
    assert content(spark, path) == anew(spark, AFTER)
    # a document that went comes back, one is replaced a second time
    segments.refresh(frame(spark, [(3, "blue hen again"), (2, "red hen house")]), path)
    third = [(1, "red fox fox"), (5, "blue fox"), (3, "blue hen again"), (2, "red hen house")]
    assert content(spark, path) == anew(spark, third)
    assert content(spark, path, 1) == anew(spark, OLD)
    assert segments.merge(spark, path) == 4
    assert len(segments.segments(spark, path)) == 1 and content(spark, path) == anew(spark, third)
    assert len(segments.clean(spark, path, keep=2)) == 0 and content(spark, path, 3) == anew(spark, third)
    assert len(segments.clean(spark, path)) == 3
    assert segments.versions(spark, path) == [4] and content(spark, path) == anew(spark, third)
    with pytest.raises(ValueError):
        segments.clean(spark, path, keep=0)


def test_a_refresh_that_stops_after_any_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.refresh(frame(spark, OLD), path)
    write, publish = segments._write, segments._publish
    before = content(spark, path)
    for stop in range(6):
        done = []

        def failing(df, folder):
            if len(done) == stop:
                raise RuntimeError("stopped")
            write(df, folder)
            done.append(folder)

        def half_published(spark, path, names):
            if stop < 5:
                raise AssertionError("never reached")
            (tmp_path / "index" / "manifests" / "0000000002").mkdir()
            (tmp_path / "index" / "manifests" / "0000000002" / "part-0.json").write_text('{"segment": "none"}\n')
            raise RuntimeError("stopped")

        monkeypatch.setattr(segments, "_write", failing)
        monkeypatch.setattr(segments, "_publish", half_published)
        with pytest.raises(RuntimeError, match="stopped"):
            segments.refresh(frame(spark, NEW), path)
        assert len(done) == stop
        assert segments.versions(spark, path) == [1]
        assert sorted(tuple(r)[:4] for r in segments.read(spark, path)[1].select("doc_id", "term", "tf", "doc_len").collect()) == before[1]
    monkeypatch.setattr(segments, "_write", write)
    monkeypatch.setattr(segments, "_publish", publish)
    # the manifest that was half written keeps its number
    assert segments.refresh(frame(spark, NEW), path)["version"] == 3
    assert len(segments.clean(spark, path, keep=2)) == 5  # the first stop was before any write
    assert content(spark, path) == anew(spark, AFTER)


def test_documents_without_tokens(spark, tmp_path):
    path = str(tmp_path / "index")
    assert segments.refresh(frame(spark, [(1, "..."), (2, None)]), path)["total"] == 0
    assert content(spark, path) == ([], [], {})
    segments.refresh(frame(spark, OLD), path)
    assert content(spark, path) == anew(spark, OLD)
    assert segments.refresh(frame(spark, [(i, "") for i in range(1, 5)]), path)["removed"] == 3
    assert content(spark, path) == ([], [], {})


def test_given_terms_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.refresh(frame(spark, OLD), path)
    posts = segments.read(spark, path)[1].where("term = 'fox'")
    assert "EqualTo(term,fox)" in posts._jdf.queryExecution().executedPlan().toString()
    assert [r["tf"] for r in posts.collect()] == [2]
