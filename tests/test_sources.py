from __future__ import annotations

import bz2
import json

import pytest
from pyspark.sql import functions as F

from entitylake.plans import jobs
from entitylake.schemas import ENTITY, TRUTH
from entitylake.sources import readers, stage, writers
from entitylake.sources.dump import decode_pages, decode_quality, read_dump

HEAD = "<mediawiki>\n  <siteinfo><sitename>S</sitename></siteinfo>\n"


def page(title, text, close=True):
    end = "</text>\n    </revision>\n  </page>\n" if close else "\n  </page>\n"
    return f'  <page>\n    <title>{title}</title>\n    <ns>0</ns>\n    <revision>\n      <id>7</id>\n      <text bytes="3" xml:space="preserve">{text}{end}'


DUMP = (
    HEAD
    + page("A &amp; B", "'''A''' is a &lt;b&gt;band&lt;/b&gt;.\n\n[[Category:Musical groups]]")
    + page("Cut off", "A &quot;singer&quot;.\n\n[[Category:Music]] [[Category:Singers]]", close=False)
    + "  <page><title>No text</title><revision><text/></revision></page>\n"
    + "  <page><title></title><revision><text>x</text></revision></page>\n"
    + page("Stone", "A stone.")
    + "</mediawiki>\n"
)


@pytest.fixture(params=["xml", "xml.bz2"])
def dump(request, tmp_path):
    path = tmp_path / f"dump.{request.param}"
    data = DUMP.encode()
    path.write_bytes(bz2.compress(data) if request.param.endswith("bz2") else data)
    return str(path)


def test_dump_pages(spark, dump):
    pages = {r.title: r.text for r in decode_pages(read_dump(spark, dump)).collect()}
    assert set(pages) == {"A & B", "Cut off", "Stone"}
    assert pages["A & B"] == "'''A''' is a <b>band</b>.\n\n[[Category:Musical groups]]"
    assert pages["Cut off"].startswith('A "singer".')  # not well-formed, salvaged
    assert decode_quality(read_dump(spark, dump)).first().asDict() == {"chunks": 6, "pages": 5, "decoded": 3, "rejected": 2}


def test_first_revision_counts(spark):
    chunk = "<page><title>T</title><revision><text>one</text></revision><revision><text>two</text></revision>"
    row = decode_pages(spark.createDataFrame([(chunk,)], "value string")).first()
    assert (row.title, row.text) == ("T", "one")


def test_extract_job(spark, dump, tmp_path):
    out, lookup = str(tmp_path / "entities"), str(tmp_path / "lookup")
    assert jobs.extract(spark, dump, out, lookup) == {"entities": 2, "artist": 1, "band": 1}
    rows = {r.id: r for r in readers.read_entities(spark, out).collect()}
    assert rows["A_&_B"].abstract == "A is a band." and rows["Cut_off"].type == "artist"
    tsv = spark.read.option("sep", "\t").option("header", True).csv(lookup)
    assert tsv.columns == ["id", "title", "type", "url"] and tsv.count() == 2
    assert jobs.extract(spark, dump, out, limit=1) == {"entities": 1, "artist": 0, "band": 1}


def test_tolerant_json_lines(spark, tmp_path):
    good = json.dumps({"query": "q", "relevant": "r"})
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n{{broken\n{good}\n")
    assert readers.read_json_lines(spark, str(tmp_path), TRUTH).count() == 2
    checked = readers.read_json_lines_checked(spark, str(tmp_path), TRUTH).cache()
    bad = checked.where(F.col(readers.BAD_RECORD).isNotNull())
    assert checked.count() == 3 and [r[readers.BAD_RECORD] for r in bad.collect()] == ["{broken"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("i1", ["a"]), ("i2", None)], "id string, categories array<string>")
    entities = df.select("id", "categories", F.lit("x").alias("title"))
    writers.write_parquet(entities, str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p")).exceptAll(entities).count() == 0
    writers.write_json_lines(entities, str(tmp_path / "j"), parts=1)
    assert len(list((tmp_path / "j").glob("part-*.json"))) == 1
    back = readers.read_entities(spark, str(tmp_path / "j"))
    assert back.columns == ENTITY.fieldNames() and {r.id: r.categories for r in back.collect()} == {"i1": ["a"], "i2": None}
    assert '"categories"' not in next(line for f in (tmp_path / "j").glob("part-*") for line in f.read_text().splitlines() if "i2" in line)
    writers.write_sample(entities, str(tmp_path / "s"), ["id"], n=1)
    assert [r.id for r in spark.read.json(str(tmp_path / "s")).collect()] == ["i1"]


def test_sorted_id_file(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), ("b",)], "entity_id string")
    writers.write_ids(ids, str(tmp_path / "ids"))
    lines = [line for f in sorted((tmp_path / "ids").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(x)["entity_id"] for x in lines] == ["a", "b"]


def test_evaluation_files(spark, tmp_path):
    judged = spark.createDataFrame(
        [("a", "q", "x", 1, True), ("b", "q", "y", 1, False)],
        "method string, query string, first_result string, total_relevant long, correct boolean",
    )
    writers.write_evaluation(judged, str(tmp_path / "e"), "b", "a")
    assert spark.read.json(str(tmp_path / "e/queries")).count() == 2
    assert {r.method: r.accuracy for r in spark.read.json(str(tmp_path / "e/methods")).collect()} == {"a": 1.0, "b": 0.0}
    assert spark.read.json(str(tmp_path / "e/comparison")).first().winner == "a"


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = stage.staged(spark.range(5).withColumn("x", F.col("id") * 2))
    assert [r.x for r in df.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles())


def test_limits(spark):
    df = spark.range(100)
    assert readers.limited(df, None) is df
    assert [r.id for r in readers.limited(df.orderBy(F.desc("id")), 3, ["id"]).collect()] == [0, 1, 2]
    assert readers.limited(df, 3).count() == 3


def test_a_shared_folder_is_needed(spark, monkeypatch):
    monkeypatch.setattr(stage, "SHARED_FOLDER", "spark.no.such.setting")
    assert stage.shared_folder(spark) == spark.conf.get("spark.sql.warehouse.dir") + "/.staged"
    old = spark.conf.get("spark.sql.warehouse.dir")

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    assert old
    with pytest.raises(ValueError, match="spark.no.such.setting"):
        stage.shared_folder(Unset)


def test_staged_tables_go_when_released(spark):
    from pathlib import Path

    df = stage.staged(spark.range(5), "owner of a test")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and df.count() == 5
    stage.release(spark, "another owner")
    assert folder.exists()
    stage.release(spark, "owner of a test")
    assert not folder.exists()


def decoded(spark, *chunks):
    rows = decode_pages(spark.createDataFrame([(c,) for c in chunks], "value string")).collect()
    return [(r.title, r.text) for r in rows]


def test_only_the_first_revision_counts(spark):
    revision = "<revision><text>{}</text></revision>"
    page = "<page><title>T</title>" + revision.format("first") + "<revision><text/></revision>"
    assert decoded(spark, page) == [("T", "first")]
    assert decoded(spark, page.replace("<title>T", "<title>T<br>")) == [("T<br>", "first")]  # salvaged by pattern
    empty = "<page><title>T</title><revision><text bytes='0' /></revision>" + revision.format("second")
    assert decoded(spark, empty) == []
    assert decoded(spark, empty.replace("<title>T", "<title>T<br>")) == []


def test_numeric_references_of_salvaged_pages(spark):
    page = "<page><title>T&#39;s &amp;amp; &#xE9;</title><revision><text>&#233;&#128512;&#0;&#xD800; &lt;b&gt;&#60;x"
    assert decoded(spark, page) == [("T's &amp; é", "é😀&#0;&#xD800; <b><x")]
