"""Names, links between two sources, deduplication and type filters.

Two sources: the pages fetched by https and those fetched by http, linked by title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import query, table
from bindings import sqltext as S
from entitylake.functions import text as X
from entitylake.operators import browse, link, quality
from entitylake.operators.classify import classify, classify_stats, false_match
from entitylake.operators.entities import entity_id, entity_url, lookup_rows
from entitylake.rules import FalseMatchRules, TypeRules

SITE = "https://example.org/wiki/"
TITLE = r"<h1>([^<]+)</h1>"


def titled_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", "url", X.first_match("html", TITLE).alias("title"))


def sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both sides: the pages fetched by https and those fetched by http."""
    pages = titled_pages(spark, sf)
    secure = F.startswith("url", F.lit("https://"))
    left = pages.where(secure).select("page_id", F.col("title").alias("name"), "url")
    right = pages.where(~secure).select(F.col("page_id").alias("other_id"), "title", "url")
    return left, right


SOURCES_SQL = f"""
left_pages AS (SELECT page_id, {S.TITLE} AS name, url FROM pages WHERE starts_with(url, 'https://')),
right_pages AS (SELECT page_id AS other_id, {S.TITLE} AS title, url AS wiki_url
                FROM pages WHERE NOT starts_with(url, 'https://')),
linked AS (
  SELECT l.*, {S.name_key('l.name')} AS name_norm, r.*, {S.name_key('r.title')} AS title_norm
  FROM left_pages l JOIN right_pages r ON {S.name_key('l.name')} = {S.name_key('r.title')})
"""


@query(
    "normalize_names",
    f"SELECT page_id, {S.TITLE} AS title, {S.name_key(S.TITLE)} AS title_norm FROM pages",
)
def normalize_names(spark, sf):
    return link.with_name_key(titled_pages(spark, sf), "title", "title_norm").drop("url")


def linked(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sources(spark, sf)
    return link.link(left, right, spread_left_by=["page_id"], spread_right_by=["other_id"])


@query("entity_join", f"WITH {SOURCES_SQL} SELECT * FROM linked")
def entity_join(spark, sf):
    return linked(spark, sf)


@query(
    "join_sample",
    f"""WITH {SOURCES_SQL}
SELECT page_id, other_id, name AS left_name, title AS right_title, url FROM linked
ORDER BY page_id, other_id LIMIT 10""",
)
def join_sample(spark, sf):
    view = linked(spark, sf).select(
        "page_id",
        "other_id",
        F.col("name").alias("left_name"),
        F.col("title").alias("right_title"),
        "url",
    )
    return browse.head(view, 10, ["page_id", "other_id"])


@query(
    "sample_head",
    f"WITH {SOURCES_SQL} SELECT * FROM linked ORDER BY page_id, other_id LIMIT 100",
)
def sample_head(spark, sf):
    return browse.head(linked(spark, sf), 100, ["page_id", "other_id"])


@query(
    "join_stats",
    f"""WITH {SOURCES_SQL}, n AS (
  SELECT (SELECT count(*) FROM left_pages) AS left_total,
         (SELECT count(*) FROM right_pages) AS right_total,
         (SELECT count(*) FROM linked) AS joined,
         (SELECT count(DISTINCT name) FROM linked) AS left_matched,
         (SELECT count(DISTINCT title) FROM linked) AS right_matched)
SELECT *, round(CASE WHEN left_total > 0 THEN left_matched * 100.0 / left_total ELSE 0 END, 6)::DOUBLE
       AS match_rate FROM n""",
)
def join_stats(spark, sf):
    return link.link_stats(*sources(spark, sf))


@query(
    "join_stats_skewed",
    f"""WITH n AS (
  SELECT (SELECT count(*) FROM lineitem) AS left_total, (SELECT count(*) FROM part) AS right_total,
    (SELECT sum(a.n * b.n) FROM (SELECT l_returnflag k, count(*) n FROM lineitem GROUP BY 1) a
      JOIN (SELECT {S.name_key('left(p_type, 1)')} k, count(*) n FROM part GROUP BY 1) b
      ON lower(a.k) = b.k)::BIGINT AS joined,
    (SELECT count(DISTINCT l_returnflag) FROM lineitem
      WHERE lower(l_returnflag) IN (SELECT lower(left(p_type, 1)) FROM part)) AS left_matched,
    (SELECT count(DISTINCT left(p_type, 1)) FROM part
      WHERE lower(left(p_type, 1)) IN (SELECT lower(l_returnflag) FROM lineitem)) AS right_matched)
SELECT left_total, right_total, coalesce(joined, 0) AS joined, left_matched, right_matched,
  round(left_matched * 100.0 / left_total, 6)::DOUBLE AS match_rate FROM n""",
)
def join_stats_skewed(spark, sf):
    """Three keys hold all rows of the left side; no pair is formed."""
    left = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"))
    right = table(spark, sf, "part").select(F.substring("p_type", 1, 1).alias("title"))
    return link.link_stats(left, right)


@query(
    "entity_lookup",
    f"""SELECT replace({S.TITLE}, ' ', '_') AS id, {S.TITLE} AS title, {S.SECTION} AS type,
  '{SITE}' || replace({S.TITLE}, ' ', '_') AS url FROM pages""",
)
def entity_lookup(spark, sf):
    pages = titled_pages(spark, sf)
    entities = pages.select(
        entity_id("title").alias("id"),
        "title",
        X.first_match("url", r"^https?://[^/]+/([a-z]+)/").alias("type"),
        entity_url("title", SITE).alias("url"),
    )
    return lookup_rows(entities)


# --- types -------------------------------------------------------------------

SEGMENTS = ("BUILDING", "MACHINERY")


@query("filter_types", f"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN {SEGMENTS}")
def filter_types(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return quality.keep_types(customers, SEGMENTS, "c_mktsegment")


@query(
    "type_counts",
    "SELECT coalesce(event_type, 'unknown') AS type, count(*) AS n FROM events GROUP BY 1",
)
def type_counts(spark, sf):
    return quality.type_counts(table(spark, sf, "events"), "event_type")


@query(
    "filter_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (c_mktsegment IN {SEGMENTS}) AS kept,
  count(*) FILTER (c_mktsegment NOT IN {SEGMENTS}) AS filtered_out,
  round(count(*) FILTER (c_mktsegment IN {SEGMENTS}) * 100.0 / count(*), 6)::DOUBLE AS retention
FROM customer""",
)
def filter_summary(spark, sf):
    return quality.filter_summary(table(spark, sf, "customer"), SEGMENTS, "c_mktsegment")


# --- rules bound to the part table --------------------------------------------

PART_FALSE_MATCH = FalseMatchRules(
    protected=("economy",), wrong=("promo", "brand#1"), on_topic=("widget", "ring"), max_off_topic=3
)
PART_TYPES = TypeRules(
    types=(("tool", ("brand#1", "medium")), ("ring", ("brand#2",))),
    title_words=("widget", "gizmo"),
    title_words_type="tool",
    whole_word="ring",
    whole_word_type="ring",
    signals=("economy", "anvil", "large", "gizmo"),
    off_topic=("promo",),
    infobox=r"(?i)\{\{\s*Infobox\s+standard",
    infobox_type="tool",
)


def part_categories(c: str = "p_name") -> Column:
    return F.concat(F.split(c, " "), F.array("p_brand", "p_type"))


CATS_SQL = "lower(p_name || ' ' || p_brand || ' ' || p_type)"


@query(
    "false_positive_flag",
    f"""SELECT p_partkey, CASE WHEN contains({CATS_SQL}, 'economy') THEN false
  WHEN regexp_matches({CATS_SQL}, 'promo|brand#1') THEN true
  ELSE NOT regexp_matches({CATS_SQL}, 'widget|ring') AND len(string_split(p_name, ' ')) + 2 > 3 END AS wrong
FROM part""",
)
def false_positive_flag(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", false_match(part_categories(), PART_FALSE_MATCH).alias("wrong"))


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.concat(F.lit("{{Infobox "), "p_type", F.lit("\n}}")).alias("text"),
        F.array("p_brand", "p_type").alias("categories"),
    )


DECISION_SQL = r"""
parts AS (SELECT *, lower(p_brand || ' ' || p_type) AS cats,
                 lower(p_name || ' ' || p_brand || ' ' || p_type) AS both_texts FROM part),
gates AS (SELECT *, CASE
    WHEN contains(cats, 'promo') THEN 'off_topic'
    WHEN regexp_matches(both_texts, 'economy|anvil|large|gizmo') THEN NULL
    WHEN NOT regexp_matches(both_texts, '\bring\b') THEN 'no_evidence'
    WHEN NOT regexp_matches(cats, 'brand#1|medium|brand#2') THEN 'word_without_category' END AS gate
  FROM parts),
decided AS (SELECT p_partkey, gate, CASE WHEN gate IS NOT NULL THEN NULL
    WHEN regexp_matches(cats, 'brand#1|medium') THEN 'tool'
    WHEN contains(cats, 'brand#2') THEN 'ring'
    WHEN regexp_matches(p_name, 'widget|gizmo') THEN 'tool'
    WHEN regexp_matches(p_name, '\bring\b') THEN 'ring'
    WHEN p_type = 'STANDARD' THEN 'tool' END AS type FROM gates)
"""


@query(
    "classify_entities",
    f"WITH {DECISION_SQL} SELECT p_partkey, type FROM decided WHERE type IS NOT NULL",
)
def classify_entities(spark, sf):
    return classify(part_pages(spark, sf), rules=PART_TYPES).select("p_partkey", "type")


@query(
    "classify_stats",
    f"""WITH {DECISION_SQL} SELECT CASE WHEN type IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
  coalesce(type, gate, 'no_type') AS detail, count(*) AS n FROM decided GROUP BY 1, 2""",
)
def classification_stats(spark, sf):
    return classify_stats(part_pages(spark, sf), rules=PART_TYPES)


# --- deduplication --------------------------------------------------------------

ORDER = ["o_orderdate", "o_orderkey"]
STATUS_SQL = """
rows AS (SELECT o_orderkey, o_orderdate, nullif(o_custkey, 10) AS o_custkey,
                o_orderpriority IN ('1-URGENT', '5-LOW') AS wrong FROM orders),
firsts AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS first_kept FROM rows
           WHERE NOT wrong GROUP BY 1),
judged AS (SELECT r.o_orderkey, r.o_custkey, CASE
    WHEN (r.o_orderdate, r.o_orderkey) > f.first_kept THEN 'duplicate'
    WHEN wrong THEN 'filtered' ELSE 'kept' END AS status
  FROM rows r LEFT JOIN firsts f ON r.o_custkey IS NOT DISTINCT FROM f.o_custkey)
"""


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer 10 is unknown, so that a null key occurs."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", F.nullif("o_custkey", F.lit(10)).alias("o_custkey")
    )


def wrong_order() -> Column:
    return F.col("o_orderpriority").isin("1-URGENT", "5-LOW")


@query("dedupe_filter", f"WITH {STATUS_SQL} SELECT * FROM judged")
def dedupe_filter(spark, sf):
    judged = quality.dedupe_status(order_rows(spark, sf), "o_custkey", ORDER, wrong_order())
    return judged.select("o_orderkey", "o_custkey", "status")


@query("dedupe_kept", f"WITH {STATUS_SQL} SELECT o_orderkey, o_custkey FROM judged WHERE status = 'kept'")
def dedupe_kept(spark, sf):
    kept = quality.dedupe(order_rows(spark, sf), "o_custkey", ORDER, wrong_order())
    return kept.select("o_orderkey", "o_custkey")


@query(
    "dedupe_summary",
    f"""WITH {STATUS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'kept') AS kept,
  count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'duplicate') AS duplicates
FROM judged""",
)
def dedupe_summary(spark, sf):
    return quality.dedupe_summary(order_rows(spark, sf), "o_custkey", ORDER, wrong_order())
