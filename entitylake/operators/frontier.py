"""Crawl planning on tables: what to fetch next, what is missing, what is done.

Nothing here opens a connection; inputs are tables of fetched pages
(``PAGE_STORE``), id lists and listing documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake import rules as R
from entitylake.functions import text as X


def new_ids(candidates: DataFrame, done: DataFrame, key: str = "entity_id") -> DataFrame:
    """Candidates that are not done yet, each once: a repeated one is done by then.

    Both sides are reduced to distinct ids before they meet, so no id is hot.
    """
    return candidates.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def merge_ids(known: DataFrame, new: DataFrame, key: str = "entity_id") -> DataFrame:
    """All known and new ids, each once, sorted."""
    return known.select(key).union(new.select(key)).distinct().orderBy(key)


def compare_ids(wanted: DataFrame, present: DataFrame, key: str = "entity_id") -> DataFrame:
    """Each id with ``status``: both, missing (only wanted) or extra (only present).

    One aggregation of two flags, so repeated ids cost nothing after the map side.
    """
    marks = wanted.select(key, F.lit(True).alias("wanted"), F.lit(False).alias("present")).unionAll(
        present.select(key, F.lit(False), F.lit(True))
    )
    flags = marks.groupBy(key).agg(
        F.bool_or("wanted").alias("wanted"), F.bool_or("present").alias("present")
    )
    status = (
        F.when(F.col("wanted") & F.col("present"), F.lit("both"))
        .when(F.col("wanted"), F.lit("missing"))
        .otherwise(F.lit("extra"))
    )
    return flags.select(key, status.alias("status"))


def has_next_page(html: Column | str, page_no: Column | str) -> Column:
    """Whether the page links to its successor ``?page=N+1``."""
    following = F.concat(F.lit("?page="), (X.col(page_no) + 1).cast("string"))
    return F.contains(X.col(html), following)


def missing_kinds(pages: DataFrame, kinds: tuple[str, ...] = R.PAGE_KINDS, ids: DataFrame | None = None) -> DataFrame:
    """(entity_id, kind) for each kind of page an entity lacks.

    ``ids`` lists the entities begun; one of which no page was fetched lacks all
    kinds.  One flag per kind is aggregated and the absent ones are exploded;
    entities are not multiplied by kinds and no page text is read.
    """
    fetched = pages.select("entity_id", "kind")
    if ids is not None:
        fetched = fetched.unionAll(ids.select("entity_id", F.lit(None).cast("string")))
    flags = fetched.groupBy("entity_id").agg(
        *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in kinds]
    )
    absent = F.filter(
        F.array(*[F.when(~F.col(k), F.lit(k)) for k in kinds]), lambda k: k.isNotNull()
    )
    return flags.select("entity_id", F.explode(absent).alias("kind"))


def missing_counts(pages: DataFrame, kinds: tuple[str, ...] = R.PAGE_KINDS, ids: DataFrame | None = None) -> DataFrame:
    """Number of entities lacking each kind; ``ids`` as in ``missing_kinds``."""
    return missing_kinds(pages, kinds, ids).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def pages_to_fetch(
    pages: DataFrame,
    kinds: tuple[str, ...] | None = R.PAGED_KINDS,
    max_pages: int = R.MAX_PAGES_PER_KIND,
    by: list[str] = ("entity_id", "kind"),
) -> DataFrame:
    """The next page of each entity and kind whose last page links to one, up to the cap.

    The link test runs where the page is read, so only a number and a flag per
    page are aggregated, not the text.
    """
    chosen = pages if kinds is None else pages.where(F.col("kind").isin(*kinds))
    last = F.max(F.struct("page_no", "more"))
    return (
        chosen.select(*by, "page_no", has_next_page("html", "page_no").alias("more"))
        .groupBy(*by)
        .agg(last.alias("last"))
        .where(F.col("last.more") & (F.col("last.page_no") < max_pages))
        .select(*by, (F.col("last.page_no") + 1).alias("next_page"))
    )


def progress(pages: DataFrame, kinds: tuple[str, ...] = R.PAGED_KINDS) -> DataFrame:
    """Pages per kind and time of the last fetch, per entity."""
    return pages.groupBy("entity_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_pages") for k in kinds],
        F.max("ts").alias("last_ts"),
    )


def popular_tags(tags: DataFrame, min_uses: int = R.MIN_TAG_USES, max_tags: int = R.MAX_TAGS) -> DataFrame:
    """The most used tags (``slug``, ``uses``) at or above the threshold."""
    return tags.where(F.col("uses") >= min_uses).orderBy(F.desc("uses"), "slug").limit(max_tags)


def top_ids_per_tag(
    tags: DataFrame,
    listings: DataFrame,
    known: DataFrame,
    max_per_tag: int = R.MAX_ENTITIES_PER_TAG,
    key: str = "entity_id",
) -> DataFrame:
    """Ids new to ``known`` among the first entries of the chosen tags' listings.

    ``listings(slug, position, key)``; the cut per tag comes before the comparison
    with known ids and is applied on the map side as well, so a long listing is
    not moved.  Spark broadcasts ``tags`` when it is small, as ``popular_tags`` is.
    """
    chosen = listings.join(tags.select("slug"), "slug", "left_semi")
    order = Window.partitionBy("slug").orderBy("position", key)
    first = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_per_tag)
    return new_ids(first, known, key)


def frontier_batch(
    listed: DataFrame,
    done: DataFrame,
    seed: int,
    cap: int = R.MAX_FRONTIER,
    source: str = "source",
    key: str = "entity_id",
    position: str = "position",
) -> DataFrame:
    """The next batch: whole sources in seeded random order until ``cap`` ids are
    gathered, the first ``cap`` of them, and then those not done yet.

    The cap counts ids that are done, too.  Each source listed has at least one
    id, so the first ``cap`` sources of the order always suffice: the running sum
    sees at most that many rows however many sources exist.
    """
    shuffled = F.md5(F.concat(F.lit(str(seed)), F.col(source).cast("string")))
    sizes = listed.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    leading = sizes.select(source, "n", shuffled.alias("_order")).orderBy("_order", source).limit(cap)
    before = Window.orderBy("_order", source).rowsBetween(Window.unboundedPreceding, -1)
    needed = leading.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        F.col("_before") < cap
    )
    first = (
        listed.join(F.broadcast(needed.select(source, "_order")), source)
        .orderBy("_order", source, position, key)
        .limit(cap)
    )
    return new_ids(first, done, key)
