"""Records out of crawled HTML pages (``PAGE_STORE``: entity_id, kind, page_no, html).

Profile, tags and relationships come from a single page and are built inside the
row, without a shuffle.  Release and recording pages yield one output row per
table row; ``rollup`` groups those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake import rules as R
from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record
from entitylake.schemas import PERSON, RELATIONSHIPS


def profile_fields(html: Column | str, rules: R.ProfileRules | None = None) -> list[Column]:
    """One column per scalar field: the first match of its pattern, else null."""
    rules = rules or R.ProfileRules()
    return [X.first_match(html, p, g).alias(name) for name, (p, g) in rules.fields.items()]


def rating(html: Column | str) -> Column:
    """Struct (rating_percent STRING, rating_value DOUBLE), read inside the rating block only."""

    def read(values: Column) -> Column:
        return record(
            rating_percent=F.get(values, 0), rating_value=F.get(values, 1).try_cast("double")
        )

    block = F.regexp_extract(X.col(html), R.RATING_BLOCK, 0)
    return let(X.match_groups(block, R.RATING_VALUES, 2), read)


def anchor_list(html: Column | str, block: str) -> Column:
    """Distinct sorted anchor texts in the block; empty without one or with ``(none)`` in it."""
    nothing = F.array().cast("array<string>")

    def read(body: Column) -> Column:
        texts = X.sorted_unique(X.all_matches(body, R.ANCHOR_TEXT, 1))
        return F.when(body.rlike(R.EMPTY_LIST), nothing).otherwise(texts)

    return let(F.regexp_extract(X.col(html), block, 1), read)


def profiles(
    pages: DataFrame, site: str, html: str = "html", rules: R.ProfileRules | None = None
) -> DataFrame:
    """The pages' columns without ``html`` plus all profile fields and the entity's ``url``."""
    rules = rules or R.ProfileRules()
    found = pages.select(
        *[c for c in pages.columns if c != html],
        *profile_fields(html, rules),
        F.inline(F.array(rating(html))),
        *[anchor_list(html, block).alias(name) for name, block in rules.lists.items()],
    )
    if "uuid" in rules.fields:
        found = found.withColumn("url", F.concat(F.lit(site + "/artist/"), "uuid"))
    return found


def _matched(groups: Column) -> Column:
    """Generator of ``g``, the groups, for rows that match."""
    return keep_if(record(g=groups), lambda r: r["g"].isNotNull())


def release_rows(pages: DataFrame, site: str, html: str = "html") -> DataFrame:
    """One row per release table row that has the expected cells.

    ``row_no`` keeps the order in the page; with ``page_no`` it is the order in
    which titles are first seen.
    """
    others = [c for c in pages.columns if c != html]
    cells = (
        pages.select(*others, F.posexplode(X.all_matches(html, R.TABLE_ROW, 0)).alias("row_no", "tr"))
        .where(F.contains("tr", F.lit(R.RECORDING_ROW_MARK)))
        .select(*others, "row_no", _matched(X.match_groups("tr", R.RELEASE_ROW, 10)))
    )

    def cell(i: int) -> Column:
        return X.strip(F.get("g", i))

    return cells.select(
        *others,
        "row_no",
        cell(1).alias("title"),
        cell(2).alias("artist"),
        X.blank_to_null(cell(3)).alias("format"),
        cell(4).try_cast("int").alias("tracks"),
        X.blank_to_null(cell(5)).alias("country"),
        X.blank_to_null(cell(6)).alias("date"),
        X.blank_to_null(cell(7)).alias("label"),
        X.blank_to_null(cell(8)).alias("catalog"),
        X.blank_to_null(X.strip(F.replace(F.get("g", 9), F.lit(R.NO_BARCODE), F.lit("")))).alias(
            "barcode"
        ),
        F.concat(F.lit(site), F.get("g", 0)).alias("url"),
    )


def recording_rows(pages: DataFrame, site: str, html: str = "html") -> DataFrame:
    """One row per recording table row; the rating cell is optional.

    A row is what lies between two row starts, so an unclosed last row counts.
    """
    others = [c for c in pages.columns if c != html]
    cells = (
        pages.select(*others, F.posexplode(F.split(html, R.RECORDING_ROW_START)).alias("row_no", "tr"))
        .where(F.contains("tr", F.lit(R.RECORDING_ROW_MARK)))
        .select(
            *others,
            "row_no",
            _matched(
                X.match_groups(F.concat(F.lit(R.RECORDING_ROW_START), "tr"), R.RECORDING_ROW, 6)
            ),
        )
    )
    return cells.select(
        *others,
        "row_no",
        X.strip(F.get("g", 1)).alias("title"),
        X.strip(F.get("g", 2)).alias("artist"),
        F.concat(F.lit(site), F.get("g", 0)).alias("url"),
        F.get("g", 3).try_cast("double").alias("rating"),
        X.clock_seconds(F.get("g", 4)).alias("length_sec"),
        X.strip(F.get("g", 5)).alias("release_group"),
    )


def relationships(html: Column | str, site: str) -> Column:
    """Struct with the people of each kept label and all their names as text.

    Every linked person of a cell is an entry; the first parenthesised part of
    the cell is the detail of all of them.  Null ``html`` gives empty lists and
    no text.
    """

    def people(cell: Column) -> Column:
        detail = X.strip(X.first_match(cell, R.RELATION_DETAILS))

        def entry(link: Column) -> Column:
            return let(
                X.match_groups(link, R.RELATION_PERSON, 2),
                lambda g: record(
                    name=X.strip(F.get(g, 1)),
                    details=detail,
                    url=F.concat(F.lit(site), F.get(g, 0)),
                ),
            )

        return F.transform(X.all_matches(cell, R.RELATION_PERSON, 0), entry)

    def labelled(row: Column) -> Column:
        return let(
            X.match_groups(row, R.RELATION_ROW, 2),
            lambda g: record(label=X.label_key(F.get(g, 0)), cell=F.get(g, 1)),
        )

    nobody = F.array().cast(RELATIONSHIPS["members"].dataType)

    def collect(rows: Column) -> Column:
        def of(label: str) -> Column:
            cells = F.filter(rows, lambda r: r["label"] == label)
            found = F.flatten(F.transform(cells, lambda r: people(r["cell"])))
            return F.coalesce(found, nobody)

        lists = record(**{label: of(label) for label in R.RELATION_LABELS})

        def with_summary(p: Column) -> Column:
            names = F.transform(F.concat(*[p[n] for n in R.RELATION_LABELS]), lambda x: x["name"])
            text = F.when(X.col(html).isNotNull(), F.array_join(names, " "))
            return record(**{n: p[n] for n in R.RELATION_LABELS}, text_summary=text)

        return let(lists, with_summary)

    return let(F.transform(X.all_matches(html, R.RELATION_ROW, 0), labelled), collect)


def relationship_rows(pages: DataFrame, site: str, html: str = "html") -> DataFrame:
    """Edge list: one row per person with ``label``, ``name``, ``details`` and ``url``."""
    others = [c for c in pages.columns if c != html]
    found = pages.select(*others, relationships(html, site).alias("r"))

    def tagged(label: str) -> Column:
        fields = PERSON.fieldNames()
        return F.transform(
            f"r.{label}", lambda p: record(label=F.lit(label), **{f: p[f] for f in fields})
        )

    lists = [tagged(label) for label in R.RELATION_LABELS]
    return found.select(*others, F.inline(F.concat(*lists)))


def parse_stats(pages: DataFrame, profile: str = "profile", ids: DataFrame | None = None) -> DataFrame:
    """Entities seen, entities with a profile page, and those skipped for lack of one.

    ``ids`` lists the entities begun; one of which no page was fetched is skipped.
    Two small counters per entity are aggregated before the shuffle, so an entity
    with very many pages costs no more than others.
    """
    fetched = pages.select("entity_id", "kind")
    if ids is not None:
        fetched = fetched.unionAll(ids.select("entity_id", F.lit(None).cast("string")))
    has_profile = F.coalesce(F.bool_or(F.col("kind") == profile), F.lit(False))
    per_entity = fetched.groupBy("entity_id").agg(has_profile.alias("parsed"))
    return per_entity.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("parsed").alias("parsed"),
        F.count_if(~F.col("parsed")).alias("skipped"),
    )


def listed_ids(pages: DataFrame, pattern: str, html: str = "html", id_name: str = "entity_id") -> DataFrame:
    """All ids found in listing documents, with their position in the document."""
    others = [c for c in pages.columns if c != html]
    return pages.select(
        *others, F.posexplode(X.all_matches(html, pattern, 1)).alias("position", id_name)
    )


def sitemaps(indexes: DataFrame, site: str, body: str = "html") -> DataFrame:
    """The entity sitemaps listed in sitemap index documents (column ``sitemap``)."""
    pattern = f"<loc>({X.java_literal(site)}/sitemap-artist-[^<]+)</loc>"
    return listed_ids(indexes, pattern, body, "sitemap")


def sitemap_ids(documents: DataFrame, site: str, body: str = "html") -> DataFrame:
    """The entity ids listed in sitemap documents."""
    return listed_ids(documents, X.java_literal(site) + R.ENTITY_LINK, body)


def tag_counts(pages: DataFrame, pattern: str = R.LISTED_TAG, html: str = "html") -> DataFrame:
    """(slug, name, uses) of each tag listed; ``1,234`` becomes 1234."""
    others = [c for c in pages.columns if c != html]
    listed = pages.select(*others, F.explode(X.all_matches(html, pattern, 0)).alias("hit"))
    return listed.select(*others, X.match_groups("hit", pattern, 3).alias("g")).select(
        *others,
        F.get("g", 0).alias("slug"),
        X.strip(F.get("g", 1)).alias("name"),
        F.replace(F.get("g", 2), F.lit(","), F.lit("")).try_cast("bigint").alias("uses"),
    )
