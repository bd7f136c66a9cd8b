"""Linked records: lookups, samples, display views and searchable documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindings import query, table
from bindings.derived import RECORDS_SQL, SITE, records
from entitylake.operators import browse
from entitylake.operators.documents import build_documents, build_field_documents
from entitylake.schemas import JOINED, conform


def _conformed(spark, sf):
    """Records with every declared column, keyed by part."""
    derived = records(spark, sf)
    return conform(derived, JOINED).where("uuid IS NOT NULL")


def _lines(c: str, *fields: str) -> Column:
    return F.array_join(F.transform(c, lambda r: F.concat_ws("/", *[r[f] for f in fields])), ";")


@query(
    "artist_lookup",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) = 'small ring' ORDER BY p_partkey LIMIT 1""",
)
def artist_lookup(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return browse.lookup(parts, "SMALL Ring", ["p_partkey"], "p_name")


@query("name_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widg')")
def name_contains(spark, sf):
    return browse.name_contains(table(spark, sf, "part").select("p_partkey", "p_name"), "WIDG", "p_name")


@query(
    "famous_names",
    """SELECT p_partkey, '* ' || p_name || ' -> ' || p_brand || ' [' || p_type || ']' AS label
FROM part WHERE p_name IN ('red widget', 'blue bolt', 'cold rod')""",
)
def famous_names(spark, sf):
    found = browse.labelled(
        table(spark, sf, "part"), ["red widget", "blue bolt", "cold rod"], "* %s -> %s [%s]",
        "p_name", "p_brand", "p_type", column="p_name",
    )
    return found.select("p_partkey", "label")


@query(
    "random_sample",
    """SELECT doc_id, lang, source FROM documents ORDER BY md5('17' || doc_id), doc_id LIMIT 20""",
)
def random_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return browse.random_sample(docs, 20, seed=17, key="doc_id")


R_TITLE = "CASE WHEN i = 4 THEN 'Unknown' ELSE 'R' || i || ' of ' || p_name END"


@query(
    "simplify_nested",
    f"""WITH {RECORDS_SQL} SELECT uuid, array_to_string([{R_TITLE} FOR i IN rel], '|') AS releases,
  array_to_string(['Song ' || i FOR i IN rec], '|') AS recordings FROM records WHERE uuid IS NOT NULL""",
)
def simplify_nested(spark, sf):
    simple = browse.simplify(_conformed(spark, sf))
    return simple.select("uuid", *[F.array_join(c, "|").alias(c) for c in ("releases", "recordings")])


@query(
    "nested_size_slice",
    f"""WITH {RECORDS_SQL} SELECT uuid, len(rel)::INTEGER AS n_releases,
  array_to_string([{R_TITLE} FOR i IN rel[1:5]], '|') AS first_releases FROM records WHERE uuid IS NOT NULL""",
)
def nested_size_slice(spark, sf):
    return _conformed(spark, sf).select(
        "uuid",
        browse.size_of("releases").alias("n_releases"),
        F.array_join(F.slice(browse.titles_only("releases"), 1, 5), "|").alias("first_releases"),
    )


RELEASE_LINE = f"""{R_TITLE} || '/' || CASE WHEN i % 3 = 0 THEN '19' || p_size ELSE 'Unknown date' END
  || '/' || CASE WHEN i % 2 = 0 THEN p_type ELSE 'Unknown format' END"""
# 30.5 seconds per number; every third has no length
CLOCK_LINE = """'Song ' || i || '/' || CASE WHEN i % 3 = 0 THEN '?' ELSE floor(i * 30.5 / 60)::INT || ':'
  || lpad((floor(i * 30.5)::INT % 60)::VARCHAR, 2, '0') END"""


@query(
    "profile_releases",
    f"""WITH {RECORDS_SQL} SELECT uuid, array_to_string([{RELEASE_LINE} FOR i IN rel[1:10]], ';') AS release_lines,
  greatest(len(rel) - 10, 0)::INTEGER AS more_releases FROM records WHERE uuid IS NOT NULL""",
)
def profile_releases(spark, sf):
    view = browse.profile(_conformed(spark, sf))
    return view.select("uuid", _lines("release_lines", "title", "date", "format").alias("release_lines"), "more_releases")


@query(
    "profile_recordings",
    f"""WITH {RECORDS_SQL} SELECT uuid, array_to_string([{CLOCK_LINE} FOR i IN rec[1:15]], ';') AS recording_lines,
  greatest(len(rec) - 15, 0)::INTEGER AS more_recordings FROM records WHERE uuid IS NOT NULL""",
)
def profile_recordings(spark, sf):
    view = browse.profile(_conformed(spark, sf))
    return view.select("uuid", _lines("recording_lines", "title", "length").alias("recording_lines"), "more_recordings")


@query(
    "profile_counts",
    f"""WITH {RECORDS_SQL} SELECT uuid, coalesce(array_to_string(categories[1:10], '|'), '') AS first_categories,
  greatest(coalesce(len(categories), 0) - 10, 0)::INTEGER AS more_categories,
  coalesce(array_to_string(members, '|'), '') AS member_names, len(rel)::INTEGER AS n_releases,
  len(rec)::INTEGER AS n_recordings FROM records WHERE uuid IS NOT NULL""",
)
def profile_counts(spark, sf):
    view = browse.profile(_conformed(spark, sf))
    return view.select(
        "uuid",
        F.coalesce(F.array_join("first_categories", "|"), F.lit("")).alias("first_categories"),
        "more_categories",
        F.coalesce(F.array_join("member_names", "|"), F.lit("")).alias("member_names"),
        "n_releases",
        "n_recordings",
    )


@query(
    "compact_view",
    f"""WITH {RECORDS_SQL} SELECT uuid, name, title, coalesce(area, origin, 'N/A') AS place,
  coalesce(nullif(array_to_string(genres, ', '), ''), genre, 'N/A') AS genres,
  CASE WHEN length(abstract) > 200 THEN abstract[1:200] || '...' ELSE abstract END AS abstract,
  len(rel)::INTEGER AS n_releases, len(rec)::INTEGER AS n_recordings FROM records WHERE uuid IS NOT NULL""",
)
def compact_view(spark, sf):
    return browse.compact(_conformed(spark, sf))


DOCUMENT_SQL = f"""
{RECORDS_SQL},
filled AS (SELECT *, coalesce(name, 'Unknown') AS d_name,
    CASE WHEN len(categories) > 0 THEN categories WHEN len(genres) > 0 THEN genres ELSE ['Unknown'] END AS d_genres,
    coalesce(wiki_type, type, 'Unknown') AS d_type, coalesce(founded_in, 'Unknown') AS d_founded,
    coalesce(area, 'Unknown') AS d_area,
    array_to_string([CASE WHEN i = 4 THEN p_brand ELSE 'R' || i || ' of ' || p_name || ' ' || p_brand END FOR i IN rel], ' ') AS rel_text,
    array_to_string(['R' || i || ' of ' || p_name FOR i IN rel IF i <> 4], ' ') AS rel_titles,
    array_to_string(['Song ' || i FOR i IN rec], ' ') AS rec_text
  FROM records WHERE uuid IS NOT NULL)
"""


@query(
    "build_docs",
    f"""WITH {DOCUMENT_SQL} SELECT uuid AS doc_id, d_name AS name,
  concat_ws(' ', d_name, array_to_string(d_genres, ' '), d_type, d_founded, d_area, abstract,
    nullif(rel_text, ''), nullif(rec_text, ''), array_to_string(members, ' ')) AS text,
  coalesce(wiki_url, url, '{SITE}/artist/' || uuid) AS url, d_type AS type, array_to_string(d_genres, '|') AS genres,
  d_founded AS founded_in, d_area AS area, coalesce(rating_value, 0)::DOUBLE AS rating FROM filled""",
)
def build_docs(spark, sf):
    docs = build_documents(records(spark, sf), SITE)
    return docs.select("doc_id", "name", "text", "meta.*").withColumn("genres", F.array_join("genres", "|"))


@query(
    "build_field_docs",
    f"""WITH {DOCUMENT_SQL} SELECT uuid AS doc_id, d_name AS name, coalesce(type, wiki_type, 'Unknown') AS type,
  coalesce(array_to_string(categories, ' '), '') AS genres, d_area AS area,
  concat_ws(' ', d_name, nullif(array_to_string(categories, ' '), ''), coalesce(type, wiki_type, 'Unknown'), d_area,
    abstract, nullif(rel_titles, '')) AS content, coalesce(wiki_url, url, '') AS url,
  coalesce(try_cast(founded_in AS INTEGER), 0) AS founded_year FROM filled""",
)
def build_field_docs(spark, sf):
    return build_field_documents(records(spark, sf))
