"""Searchable documents out of linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions.text import blank_to_null, strip
from entitylake.rules import RELATION_LABELS
from entitylake.schemas import JOINED, conform

UNKNOWN = "Unknown"


def first_filled(*columns: str | Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def first_filled_list(*columns: str) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in columns])


def joined_text(*parts: Column) -> Column:
    """Non-empty parts joined by blanks."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def _field_texts(array: str, *fields: str) -> Column:
    texts = F.transform(array, lambda x: joined_text(*[x[f] for f in fields]))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def with_ids(records: DataFrame) -> DataFrame:
    """Records that have an id, with all columns the builders read."""
    return conform(records, JOINED).where("uuid != ''")


def build_documents(records: DataFrame, site: str) -> DataFrame:
    """One document per record: ``doc_id``, ``name``, ``text`` and a ``meta`` struct.

    The text joins name, genres, other tags, type, place, area, abstract, titles
    and artists of releases, titles of recordings and the names of related
    people.  Missing name, genres, type, place and area are the word ``Unknown``,
    which therefore is a searchable token.
    """
    r = with_ids(records)
    unknown = F.lit(UNKNOWN)
    name = F.coalesce(first_filled("name"), unknown)
    genres = F.coalesce(first_filled_list("categories", "genres"), F.array(unknown))
    kind = F.coalesce(first_filled("wiki_type", "type"), unknown)
    founded_in = F.coalesce(first_filled("founded_in"), unknown)
    area = F.coalesce(first_filled("area"), unknown)
    url = first_filled("wiki_url", "url", F.concat(F.lit(site + "/artist/"), "uuid"))
    people = [_field_texts(f"relationships.{label}", "name") for label in RELATION_LABELS]
    return r.select(
        F.col("uuid").alias("doc_id"),
        strip(name).alias("name"),
        joined_text(
            name,
            F.array_join(genres, " "),
            F.array_join("other_tags", " "),
            kind,
            founded_in,
            area,
            F.col("abstract"),
            _field_texts("releases", "title", "artist"),
            _field_texts("recordings", "title"),
            *people,
        ).alias("text"),
        F.struct(
            url.alias("url"),
            kind.alias("type"),
            genres.alias("genres"),
            founded_in.alias("founded_in"),
            area.alias("area"),
            F.coalesce("rating_value", F.lit(0.0)).alias("rating"),
        ).alias("meta"),
    )


def build_field_documents(records: DataFrame) -> DataFrame:
    """One document per record with separate search fields.

    ``genres`` are the categories only, the type prefers the record's own, and
    ``content`` joins name, genres, type, area, abstract and release titles.
    ``founded_year`` is the place field read as a number, 0 if it is none.
    """
    r = with_ids(records)
    unknown = F.lit(UNKNOWN)
    name = F.coalesce(first_filled("name"), unknown)
    genres = F.coalesce(F.array_join("categories", " "), F.lit(""))
    kind = F.coalesce(first_filled("type", "wiki_type"), unknown)
    area = F.coalesce(first_filled("area"), unknown)
    year = F.when(F.col("founded_in").rlike(r"^\d+$"), F.col("founded_in").try_cast("int"))
    return r.select(
        F.col("uuid").alias("doc_id"),
        name.alias("name"),
        kind.alias("type"),
        genres.alias("genres"),
        area.alias("area"),
        joined_text(
            name, genres, kind, area, F.col("abstract"), _field_texts("releases", "title")
        ).alias("content"),
        F.coalesce(first_filled("wiki_url", "url"), F.lit("")).alias("url"),
        F.coalesce(year, F.lit(0)).alias("founded_year"),
    )
