"""Crawl planning: pages as fetched pages, documents and labels as id lists, events as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.extraction import BEGUN_SQL, STORE_SQL, begun, page_store
from entitylake.operators import frontier

SECTIONS = ("en", "fr", "de", "es")


def _ids(spark, sf, name, column):
    return table(spark, sf, name).select(F.col(column).alias("entity_id"))


@query("frontier_new", "SELECT doc_id AS entity_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def frontier_new(spark, sf):
    return frontier.new_ids(_ids(spark, sf, "documents", "doc_id"), _ids(spark, sf, "labels", "doc_id"))


@query("frontier_merge", "SELECT doc_id AS entity_id FROM labels UNION SELECT conv_id FROM conversations ORDER BY 1")
def frontier_merge(spark, sf):
    return frontier.merge_ids(_ids(spark, sf, "labels", "doc_id"), _ids(spark, sf, "conversations", "conv_id"))


@query(
    "set_compare",
    """SELECT coalesce(w.id, p.id) AS entity_id, CASE WHEN p.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra'
  ELSE 'both' END AS status FROM (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0) w
FULL JOIN (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F') p ON w.id = p.id""",
)
def set_compare(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entity_id"))
    present = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity_id"))
    return frontier.compare_ids(wanted, present)


@query(
    "missing_parts",
    f"""WITH {STORE_SQL}, {BEGUN_SQL} SELECT e.entity_id, k.kind FROM begun e,
  (VALUES ('en'), ('fr'), ('de'), ('es')) AS k(kind)
WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.entity_id = e.entity_id AND s.kind = k.kind)""",
)
def missing_parts(spark, sf):
    return frontier.missing_kinds(page_store(spark, sf), SECTIONS, begun(spark, sf))


@query(
    "missing_counts",
    f"""WITH {STORE_SQL}, {BEGUN_SQL}, p AS (SELECT DISTINCT entity_id, kind FROM store),
e AS (SELECT count(*) AS n FROM begun)
SELECT k.kind, (SELECT n FROM e) - (SELECT count(*) FROM p WHERE p.kind = k.kind) AS n
FROM (VALUES ('en'), ('fr'), ('de'), ('es')) AS k(kind)
WHERE (SELECT n FROM e) > (SELECT count(*) FROM p WHERE p.kind = k.kind)""",
)
def missing_counts(spark, sf):
    return frontier.missing_counts(page_store(spark, sf), SECTIONS, begun(spark, sf))


# A page of the store links on where its address carries a page number; the link is put into the text.
LINKED_SQL = f"""{STORE_SQL}, linked AS (SELECT page_id, entity_id, kind, page_id % 6 + 1 AS page_no,
  html || ' ?page=' || (page_id % 6 + 1 + page_id % 2) AS html FROM store)"""


def linked_pages(spark, sf):
    number = (F.col("page_id") % 6 + 1).cast("int")
    tail = F.concat(F.lit(" ?page="), (number + F.col("page_id") % 2).cast("string"))
    return page_store(spark, sf).select(
        "page_id", "entity_id", "kind", number.alias("page_no"), F.concat("html", tail).alias("html")
    )


@query(
    "has_next_page",
    f"""WITH {LINKED_SQL} SELECT page_id, page_no::INTEGER AS page_no,
  contains(html, '?page=' || (page_no + 1)) AS more FROM linked""",
)
def has_next_page(spark, sf):
    return linked_pages(spark, sf).select(
        "page_id", "page_no", frontier.has_next_page("html", "page_no").alias("more")
    )


@query(
    "pages_to_fetch",
    f"""WITH {LINKED_SQL}, l AS (SELECT entity_id, kind, max((page_no, contains(html, '?page=' || (page_no + 1)))) AS m
  FROM linked WHERE kind IN ('en', 'fr') GROUP BY 1, 2)
SELECT entity_id, kind, (m[1] + 1)::INTEGER AS next_page FROM l WHERE m[2] AND m[1] < 5""",
)
def pages_to_fetch(spark, sf):
    return frontier.pages_to_fetch(linked_pages(spark, sf), ("en", "fr"))


@query(
    "crawl_progress",
    """SELECT user_id AS entity_id, count(*) FILTER (event_type = 'view') AS view_pages,
  count(*) FILTER (event_type = 'click') AS click_pages, max(ts) AS last_ts FROM events GROUP BY 1""",
)
def crawl_progress(spark, sf):
    fetched = table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), "ts"
    )
    return frontier.progress(fetched, ("view", "click"))


TAGS_SQL = """tags AS (SELECT event_type AS slug, count(*) * 1000 AS uses FROM events GROUP BY 1
  HAVING uses >= 150000 ORDER BY uses DESC, slug LIMIT 3),
firsts AS (SELECT DISTINCT user_id AS entity_id FROM (SELECT user_id, event_type, row_number() OVER (
    PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_type IN (SELECT slug FROM tags))
  WHERE n <= 100)"""


@query(
    "tag_top_artists",
    f"""WITH {TAGS_SQL} SELECT entity_id FROM firsts
WHERE entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def tag_top_artists(spark, sf):
    events = table(spark, sf, "events")
    tags = events.groupBy(F.col("event_type").alias("slug")).agg((F.count(F.lit(1)) * 1000).alias("uses"))
    listings = events.select(
        F.col("event_type").alias("slug"), F.col("event_id").alias("position"), F.col("user_id").alias("entity_id")
    )
    known = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity_id"))
    return frontier.top_ids_per_tag(frontier.popular_tags(tags, max_tags=3), listings, known)


CAP = 300


@query(
    "frontier_batch",
    f"""WITH sizes AS (SELECT source, md5('5' || source) AS o, count(*) AS n FROM documents GROUP BY 1, 2),
needed AS (SELECT source, o FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY o, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes) WHERE before < {CAP}),
firsts AS (SELECT doc_id FROM documents JOIN needed USING (source) ORDER BY o, source, doc_id LIMIT {CAP})
SELECT doc_id AS entity_id FROM firsts WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def frontier_batch(spark, sf):
    listed = table(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("entity_id"), F.col("doc_id").alias("position")
    )
    return frontier.frontier_batch(listed, _ids(spark, sf, "labels", "doc_id"), seed=5, cap=CAP)
