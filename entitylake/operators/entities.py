"""Entity records out of encyclopedia pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import markup
from entitylake.functions.binding import keep_if, let, record
from entitylake.functions.text import col
from entitylake.operators.classify import entity_decision
from entitylake.rules import TypeRules
from entitylake.schemas import ENTITY, conform

DEFAULT_SITE = "https://en.wikipedia.org/wiki/"


def entity_id(title: Column | str) -> Column:
    return F.replace(col(title), F.lit(" "), F.lit("_"))


def entity_url(title: Column | str, site: str = DEFAULT_SITE) -> Column:
    """Blanks become underscores; nothing is percent-encoded."""
    return F.concat(F.lit(site), entity_id(title))


def extract_entities(
    pages: DataFrame,
    rules: TypeRules | None = None,
    site: str = DEFAULT_SITE,
    whole_templates: bool = False,
    main_namespace_only: bool = False,
) -> DataFrame:
    """``ENTITY`` records of the pages (``title``, ``text``) that are entities.

    A single narrow pass: categories and type are decided first, inside one
    generator that drops rejected pages, so the costly abstract and infobox
    expressions run on accepted pages only.  Pages of every namespace take part
    unless ``main_namespace_only`` leaves out titles such as ``Talk:X``.
    """
    if main_namespace_only:
        pages = pages.where(
            ~F.col("title").rlike(
                r"(?i)^(?:talk|user|wikipedia|file|mediawiki|template|help|category|portal|draft|module)"
                r"(?: talk)?:"
            )
        )

    def decision(cats: Column) -> Column:
        return let(
            entity_decision(F.col("title"), F.col("text"), cats, rules),
            lambda d: record(type=d["type"], categories=cats),
        )

    accepted = pages.select(
        "title",
        "text",
        keep_if(
            let(markup.categories("text"), decision), lambda d: d["type"].isNotNull()
        ),
    )
    described = accepted.select(
        entity_id("title").alias("id"),
        "title",
        "type",
        entity_url("title", site).alias("url"),
        "categories",
        markup.abstract("text").alias("abstract"),
        F.inline(F.array(_infobox(whole_templates))),
    )
    return conform(described, ENTITY)


def _infobox(whole_templates: bool) -> Column:
    """The infobox fields as texts; a field with several values has them joined."""
    fields = markup.infobox_fields("text", whole_templates=whole_templates)
    if not whole_templates:
        return fields
    return let(fields, lambda f: record(**{name: F.array_join(f[name], ", ") for name in markup.INFOBOX_FIELDS}))


def lookup_rows(entities: DataFrame) -> DataFrame:
    """Projection written by the lookup file: id, title, type, url."""
    return entities.select("id", "title", "type", "url")
