from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from entitylake.operators import html, rollup
from entitylake.plans import jobs
from entitylake.schemas import ARTIST, ENTITY
from entitylake.sources import readers

SITE = "https://music.example.org"
ID1 = "11111111-aaaa-bbbb-cccc-000000000001"
ID2 = "22222222-aaaa-bbbb-cccc-000000000002"

PROFILE = f"""<link href="/artist/{ID1}"><h1><a href="/x"><bdi>The X</bdi></a></h1>
<span class="comment">(<bdi>UK band</bdi>)</span><dd class="type">Group</dd>
<dt>Founded:</dt> founded: 1960-08 in Liverpool, England <a>Area: United Kingdom</a>
<a href="https://isni.org/isni.org/0000000121707484">i</a>
<h2 class="rating">Rating</h2><p><span style="width:92%">4.6</span></p>
<h3>Genres</h3><div class="genre-list"><a href="/g">rock</a>, <a href="/g"> pop </a>, <a href="/g">rock</a></div>
<h3>Other tags</h3><div id="sidebar-tag-list">(none)</div>
<p class="lastupdate">Last updated on 2024-05-01 10:00 UTC</p>"""


def release(title, fmt="CD", date="1969", label="Apple", catalog="C1", barcode="123", country="UK", direct=True):
    span = f'<span class="catalog-number">{catalog}</span>' if catalog else ""
    return f"""<tr class="odd"><td><a class="wrap-anywhere" href="/release/{title}"><bdi>{title}</bdi></a></td>
<td><bdi><a href="/artist/x">The X</a></bdi></td><td>{fmt}</td><td>17</td>
<td><abbr title="{country}">c</abbr><span class="release-date">{date}</span></td>
<td><a href="/label/1"><bdi>{label}</bdi></a>{span if direct else '</td><td>' + span}</td>
<td class="barcode-cell">{barcode}</td></tr>"""


def recording(title, length="3:30", rating=None):
    stars = f'<td class="c"><span class="current-rating" style="width:80%">{rating}</span></td>' if rating else ""
    return f"""<tr><td><a class="wrap-anywhere" href="/recording/{title}"><bdi>{title}</bdi></a></td>
<td><bdi><a href="/artist/x">The X</a></bdi></td>{stars}<td>{length}</td><td>on <a href="/rg"><bdi>G</bdi></a></td></tr>"""


def related():
    return """<tr><th>Original Members:</th> <td><a href="/artist/p1" title="t"><bdi>Pete</bdi></a></td></tr>
<tr><th class="x">members:</th>
<td><a href="/artist/p2"><bdi> Ann </bdi></a> (1996 to present), <a href="/artist/p3"><bdi>Bob</bdi></a> (x)</td></tr>
<tr><th>Associated acts:</th><td><a href="/artist/p4"><bdi>No</bdi></a></td></tr>"""


def page(spark, text):
    return spark.createDataFrame([("e", text)], "entity_id string, html string")


def test_profile(spark):
    row = html.profiles(page(spark, PROFILE), SITE).first().asDict()
    assert row == {
        "entity_id": "e", "uuid": ID1, "name": "The X", "comment": "UK band", "type": "Group", "founded": "1960-08",
        "founded_in": "Liverpool", "area": "United Kingdom", "isni_code": "0000000121707484",
        "last_updated": "2024-05-01 10:00 UTC", "rating_percent": "92", "rating_value": 4.6,
        "genres": ["pop", "rock"], "other_tags": [], "url": f"{SITE}/artist/{ID1}",
    }


def test_profile_of_an_empty_page(spark):
    row = html.profiles(page(spark, "<html></html>"), SITE).first().asDict()
    assert row.pop("genres") == [] and row.pop("other_tags") == [] and row.pop("entity_id") == "e"
    assert set(row.values()) == {None}


def test_rating_is_read_in_its_block_only(spark):
    text = '<span style="width:50%">2.5</span><h2 class="rating">R</h2><p>none</p><span style="width:60%">3</span>'
    assert tuple(page(spark, text).select(F.inline(F.array(html.rating("html")))).first()) == (None, None)


def test_release_rows(spark):
    text = "<table><tr><th>x</th></tr>" + release("A (live)", barcode="[none]") + release("B", fmt=" ", direct=False) + "<tr>bad</tr>"
    a, b = html.release_rows(page(spark, text), SITE).orderBy("row_no").collect()
    assert (a.title, a.artist, a.format, a.tracks, a.country, a.date, a.label, a.catalog, a.barcode, a.url) == (
        "A (live)", "The X", "CD", 17, "UK", "1969", "Apple", "C1", None, f"{SITE}/release/A (live)",
    )
    assert (b.format, b.catalog, b.barcode) == (None, None, "123")  # a catalog number elsewhere is not seen


def test_recording_rows(spark):
    text = recording("A", rating="4.5") + recording("B", length="1:02:03") + recording("C", length="?") + "<tr>wrap-anywhere"
    rows = html.recording_rows(page(spark, text), SITE).orderBy("row_no").collect()
    assert [(r.title, r.rating, r.length_sec, r.release_group) for r in rows] == [("A", 4.5, 210, "G"), ("B", None, 62, "G")]


def test_relationships(spark):
    r = page(spark, related()).select(html.relationships("html", SITE).alias("r")).first().r
    assert [(p.name, p.details, p.url) for p in r.members] == [
        ("Ann", "1996 to present", f"{SITE}/artist/p2"), ("Bob", "1996 to present", f"{SITE}/artist/p3"),
    ]
    assert [(p.name, p.details) for p in r.original_members] == [("Pete", None)]
    assert r.artistic_directors == [] and r.text_summary == "Ann Bob Pete"


def test_release_roll_up(spark):
    rows = spark.createDataFrame(
        [
            ("e", 2, 0, "Help! (2009)", "late", "CD", "EMI", None),
            ("e", 1, 5, "HELP!", "first", "LP", None, "1965"),
            ("e", 1, 6, "Help! (2009)", "x", "CD", "Apple", "1965"),
            ("f", 1, 0, "Help!", "other", None, None, None),
        ],
        "entity_id string, page_no int, row_no int, title string, artist string, format string, label string, date string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("country", "catalog", "barcode")})
    got = {r.entity_id: r for r in rollup.roll_up_releases(rows).collect()}
    e = got["e"]
    assert (e.title, e.artist, e.title_key) == ("HELP!", "first", "help!")
    assert (e.formats, e.labels, e.dates, e.countries) == (["CD", "LP"], ["Apple", "EMI"], ["1965"], [])
    assert (e.occurrences, e.variants) == (2, ["HELP!", "Help! (2009)"])  # distinct variants, not rows
    assert got["f"].occurrences == 1


def test_recording_roll_up(spark):
    rows = spark.createDataFrame(
        [("e", 1, 0, "A", 100, 4.0), ("e", 1, 1, "A (live)", 101, 0.0), ("e", 1, 2, "a", 0, None), ("e", 1, 3, "B", None, None)],
        "entity_id string, page_no int, row_no int, title string, length_sec int, rating double",
    )
    a, b = rollup.roll_up_recordings(rows).orderBy("title_key").collect()
    assert (a.title, a.avg_length_sec, a.avg_rating, a.occurrences) == ("A", 100.5, 4.0, 3)
    assert (b.avg_length_sec, b.avg_rating) == (None, None)


def test_means_round_half_even(spark):
    lengths = [100] * 7 + [101]  # 100.125
    rows = spark.createDataFrame(
        [("e", 1, i, "A", n, None) for i, n in enumerate(lengths)],
        "entity_id string, page_no int, row_no int, title string, length_sec int, rating double",
    )
    assert rollup.roll_up_recordings(rows).first().avg_length_sec == 100.12


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    files = {
        ID1: {
            "profile": PROFILE,
            "releases-p1": "<table>" + release("b side") + release("A") + "</table>",
            "releases-p2": release("A (live)", fmt="LP"),
            "recordings-p1": recording("Song", rating="5"),
            "relationships": related(),
        },
        ID2: {"profile": PROFILE.replace(ID1, ID2).replace("The X", "Solo")},
        "no-profile": {"releases-p1": release("lost")},
    }
    for entity, pages in files.items():
        (folder / entity).mkdir()
        for name, text in pages.items():
            (folder / entity / f"{name}.html").write_text(text, encoding="utf-8")
    return str(folder)


def test_page_store_scan_and_stats(spark, store):
    pages = readers.read_page_store(spark, store)
    assert {(r.entity_id[:2], r.kind, r.page_no) for r in pages.collect()} == {
        ("11", "profile", 1), ("11", "releases", 1), ("11", "releases", 2), ("11", "recordings", 1),
        ("11", "relationships", 1), ("22", "profile", 1), ("no", "releases", 1),
    }
    assert pages.count() == 7 and pages.where("html LIKE '%</p>'").count() == 2
    assert html.parse_stats(pages).first().asDict() == {"total": 3, "parsed": 2, "skipped": 1}


def test_parse_job_and_artist_files(spark, store, tmp_path):
    out = str(tmp_path / "artists")
    assert jobs.parse(spark, store, out, SITE) == {"parsed": 2}
    rows = {r.uuid: r for r in readers.read_artists(spark, out).collect()}
    x, solo = rows[ID1], rows[ID2]
    assert [r.title for r in x.releases] == ["A", "b side"]  # sorted by lower-cased title
    assert x.releases[0].variants == ["A", "A (live)"] and x.releases[0].formats == ["CD", "LP"]
    assert [(r.title, r.avg_length_sec, r.avg_rating) for r in x.recordings] == [("Song", 210.0, 5.0)]
    assert x.relationships.text_summary == "Ann Bob Pete"
    assert solo.releases == [] and solo.recordings == []
    assert solo.relationships.members == [] and solo.relationships.text_summary is None


def test_pretty_printed_files_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"uuid": "u", "name": "N", "releases": [{"title": "T"}]}, indent=4))
    (tmp_path / "b.json").write_text(json.dumps({"uuid": "v"}))
    rows = {r.uuid: r for r in readers.read_artist_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"u", "v"}
    row = rows["u"]
    assert (row.uuid, row.releases[0].title, row.recordings) == ("u", "T", None)


def test_two_records_in_one_file_are_not_lost_silently(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"uuid": "u"}\n{"uuid": "v"}')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_artist_files(spark, str(tmp_path)).collect()


def test_artist_lines_of_one_part_are_all_read(spark, tmp_path):
    out = str(tmp_path / "artists")
    spark.range(10).selectExpr("concat('u', id) AS uuid").coalesce(1).write.json(out)
    assert {r.uuid for r in readers.read_artists(spark, out).collect()} == {f"u{k}" for k in range(10)}


def test_parse_stats_count_entities_without_pages_or_kinds(spark):
    pages = spark.createDataFrame([("a", "profile"), ("b", None)], "entity_id string, kind string")
    assert html.parse_stats(pages).first().asDict() == {"total": 2, "parsed": 1, "skipped": 1}
    ids = spark.createDataFrame([("a",), ("c",)], "entity_id string")
    assert html.parse_stats(pages, ids=ids).first().asDict() == {"total": 3, "parsed": 1, "skipped": 2}


def test_join_clean_and_index_jobs(spark, store, tmp_path):
    artists = jobs.artists_of(readers.read_page_store(spark, store), SITE)
    assert artists.schema.simpleString() == ARTIST.simpleString()
    entity = {"type": "band", "url": "w", "abstract": "A rock band.", "genre": None, "origin": None,
              "years_active": None, "label": None, "members": None, "birth_name": None}
    entities = spark.createDataFrame(
        [
            {"id": "The_X", "title": "The X", "categories": ["Greek gods"], **entity},
            {"id": "X_(band)", "title": "X (band)", "categories": [], **entity},
            {"id": "X!", "title": "X!", "categories": ["Rock music"], **entity},
        ],
        ENTITY,
    )
    joined, kept, idx = (str(tmp_path / p) for p in ("joined", "kept", "index"))
    stats = jobs.join(artists, entities, joined, sample=str(tmp_path / "sample")).first()
    assert (stats.joined, stats.left_matched, stats.right_matched, stats.match_rate) == (2, 1, 2, 50.0)
    assert spark.read.json(str(tmp_path / "sample")).count() == 2
    summary = jobs.clean(spark, joined, kept, order_by=["uuid", "id"], parts=1).first()
    assert summary.asDict() == {"total": 2, "kept": 1, "filtered": 1, "duplicates": 0}
    records = spark.read.json(kept)
    assert [r.id for r in records.collect()] == ["X!"]
    jobs.build_index(spark.read.parquet(joined), idx, SITE)
    assert spark.read.parquet(f"{idx}/postings").where("term = 'beatles'").count() == 0
    assert spark.read.parquet(f"{idx}/terms").where("term = 'ann'").first().df >= 1


def test_a_long_recording_row_without_length_is_given_up_soon(spark):
    """The search for a missing cell is in proportion to the row, not to its square."""
    row = (
        '<tr><td><a class="wrap-anywhere" href="/recording/1"><bdi>T</bdi></a></td><td><bdi><a href="/artist/x">A</a></bdi></td>'
        + "<td>?:??</td>" + "<i>filler</i>" * 40_000
    )
    pages = spark.createDataFrame([(1, f"<table>{row}</table>")], "entity_id int, html string")
    begin = time.monotonic()
    assert html.recording_rows(pages, "s").count() == 0
    assert html.recording_rows(pages, "s").collect() == []
    assert time.monotonic() - begin < 20
