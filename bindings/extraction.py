"""Records out of HTML pages: scans, profile fields, table rows, relationships, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import query, table
from bindings import sqltext as S
from bindings.derived import (
    spread,
    SITE,
    profile_pages,
    recording_pages,
    relationship_pages,
    release_pages,
    text_of,
    uuid_sql,
)
from entitylake.functions import text as X
from entitylake.operators import html, rollup

NAVIGATION = r"(?s)<nav>(.*?)</nav>"


def page_store(spark, sf) -> DataFrame:
    """The pages as a page store: entity = host, kind = section of the site."""
    return table(spark, sf, "pages").select(
        "page_id",
        X.first_match("url", r"^https?://([^/]+)/").alias("entity_id"),
        X.first_match("url", r"^https?://[^/]+/([a-z]+)/").alias("kind"),
        F.coalesce(X.first_match("url", r"[?&]page=(\d+)").try_cast("int"), F.lit(1)).alias("page_no"),
        "url",
        "html",
    )


STORE_SQL = f"""store AS (SELECT page_id, {S.HOST} AS entity_id, {S.SECTION} AS kind, {S.PAGE_NO} AS page_no,
  url, html FROM pages)"""

BEGUN_SQL = """begun AS (SELECT entity_id FROM store UNION SELECT 'shop-' || s_suppkey FROM supplier)"""


def begun(spark, sf) -> DataFrame:
    """Entities whose fetching has begun: those with pages, and suppliers of which no page came."""
    shops = table(spark, sf, "supplier").select(F.concat(F.lit("shop-"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return page_store(spark, sf).select("entity_id").union(shops)


@query(
    "html_pages_scan",
    f"WITH {STORE_SQL} SELECT page_id, entity_id, kind, page_no, {S.TITLE} AS title, length(html) AS n_chars FROM store",
)
def html_pages_scan(spark, sf):
    return page_store(spark, sf).select(
        "page_id", "entity_id", "kind", "page_no",
        X.first_match("html", r"<h1>([^<]+)</h1>").alias("title"),
        F.length("html").cast("bigint").alias("n_chars"),
    )


@query(
    "sitemap_ids",
    """SELECT page_id, unnest(range(0, len(l)))::INTEGER AS position, unnest(l) AS link
FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS l FROM pages)""",
)
def sitemap_ids(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return html.listed_ids(pages, r'href="/([^"]+)"', id_name="link")


@query(
    "html_anchor_lists",
    f"""WITH b AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(
    regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]+)</a>', 1), lambda x: {S.strip('x')}),
    lambda x: x <> '') AS l FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(l)), '|') AS anchors FROM b""",
)
def html_anchor_lists(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.array_join(html.anchor_list("html", NAVIGATION), "|").alias("anchors"))


K, N = "c_custkey", "c_nationkey"


@query(
    "html_profile",
    f"""SELECT {K}, {uuid_sql(K)} AS uuid, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'in debt' END AS comment,
  c_mktsegment AS type, CASE WHEN {K} % 3 = 0 THEN '19' || lpad({N}::VARCHAR, 2, '0') || '-05' END AS founded,
  CASE WHEN {K} % 3 = 0 THEN 'Town ' || {N} END AS founded_in, 'Nation ' || {N} AS area,
  CASE WHEN {K} % 5 = 0 THEN '0000' || {K} || 'X' END AS isni_code, '2024-01-' || {N} AS last_updated,
  CASE WHEN {K} % 4 IN (0, 3) THEN {N}::VARCHAR END AS rating_percent,
  CASE WHEN {K} % 4 IN (0, 3) THEN {N} % 5 + 0.25 END::DOUBLE AS rating_value,
  CASE WHEN {K} % 6 = 0 THEN '' ELSE lower(c_mktsegment) || '|z' || {N} END AS genres,
  CASE WHEN {K} % 7 <> 0 THEN 'o' || {N} ELSE '' END AS other_tags,
  '{SITE}/artist/' || {uuid_sql(K)} AS url FROM customer""",
)
def html_profile(spark, sf):
    found = html.profiles(profile_pages(spark, sf), SITE)
    return found.withColumns({c: F.array_join(c, "|") for c in ("genres", "other_tags")})


RELEASE_ROWS_SQL = f"""release_rows AS (SELECT p_partkey, p_name || ' (v' || i || ')' AS title, p_brand AS artist,
  CASE WHEN i <> 2 THEN p_type END AS format, (i + 2)::INTEGER AS tracks, 'Land ' || p_size AS country,
  CASE WHEN i <> 3 THEN '200' || i || '-01' END AS date, 'Label ' || p_size AS label,
  CASE WHEN i = 1 THEN 'C-1' END AS catalog, CASE WHEN i <> 1 THEN p_partkey::VARCHAR || i END AS barcode,
  '{SITE}/release/' || p_partkey || '-' || i AS url
FROM part, range(1, 4) AS r(i) WHERE i <= p_size % 4)"""


@query("html_rows", f"WITH {RELEASE_ROWS_SQL} SELECT * FROM release_rows")
def html_rows(spark, sf):
    return html.release_rows(release_pages(spark, sf), SITE).drop("row_no")


@query(
    "html_recording_rows",
    f"""SELECT p_partkey, p_name || ' ' || i AS title, p_brand AS artist,
  '{SITE}/recording/' || p_partkey || '-' || i AS url, CASE WHEN i <> 2 THEN i + 0.5 END::DOUBLE AS rating,
  (i * 60 + p_size % 10)::INTEGER AS length_sec, 'Group ' || p_size AS release_group
FROM part, range(1, 5) AS r(i) WHERE i <= p_size % 5 AND i <> 3""",
)
def html_recording_rows(spark, sf):
    return html.recording_rows(recording_pages(spark, sf), SITE).drop("row_no")


PEOPLE_SQL = f"""people AS (
  SELECT {K}, label, c_name || tail AS name, CASE WHEN label = 'members' THEN 'from 19' || {N} || ' to now' END AS details,
    '{SITE}/artist/' || {K} || tail AS url, tail
  FROM customer, (VALUES ('members', 'a'), ('members', 'b'), ('original_members', 'c')) AS v(label, tail)
  WHERE label = 'members' OR {K} % 3 = 0)"""


@query("html_relationships", f"WITH {PEOPLE_SQL} SELECT {K}, label, name, details, url FROM people")
def html_relationships(spark, sf):
    return html.relationship_rows(relationship_pages(spark, sf), SITE)


@query(
    "relationship_summary",
    f"""WITH {PEOPLE_SQL} SELECT {K}, string_agg(name, ' ' ORDER BY tail) AS text_summary,
  count(*) FILTER (label = 'members') AS n_members FROM people GROUP BY 1""",
)
def relationship_summary(spark, sf):
    found = relationship_pages(spark, sf).select(K, html.relationships("html", SITE).alias("r"))
    return found.select(K, "r.text_summary", F.size("r.members").cast("bigint").alias("n_members"))


@query(
    "parse_stats",
    f"""WITH {STORE_SQL}, {BEGUN_SQL}, e AS (SELECT entity_id, coalesce(bool_or(kind = 'en'), false) AS parsed
  FROM begun LEFT JOIN store USING (entity_id) GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS skipped FROM e""",
)
def parse_stats(spark, sf):
    return html.parse_stats(page_store(spark, sf), "en", begun(spark, sf))


@query(
    "tag_counts",
    """SELECT p_partkey, replace(p_name, ' ', '+') AS slug, p_name AS name,
  p_partkey * 1000 + p_size AS uses FROM part""",
)
def tag_counts(spark, sf):
    parts = table(spark, sf, "part")
    listing = text_of(
        '<li><a href="/tag/', F.replace("p_name", F.lit(" "), F.lit("+")), '"> ', F.col("p_name"), "</a>\n<i>has been used ",
        F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0), " times</i></li>",
    )
    return html.tag_counts(parts.select("p_partkey", listing.alias("html")))


# --- roll-ups: line items as releases and recordings of a brand -----------------


def item_rows(spark, sf) -> DataFrame:
    """Each line item as a release and recording of its part's brand, titled by the part."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    items = spread(items, "l_orderkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("entity_id"),
        text_of(F.initcap("p_name"), " (", F.col("p_type"), ")").alias("title"),
        F.col("p_type").alias("artist"),
        F.col("l_returnflag").alias("format"),
        F.when(F.col("p_size") > 25, text_of("Label ", F.col("p_size"))).alias("label"),
        F.col("l_linestatus").alias("country"),
        F.date_format("l_shipdate", "yyyy").alias("date"),
        F.col("l_linenumber").cast("string").alias("catalog"),
        F.lit(None).cast("string").alias("barcode"),
        (F.col("l_quantity") % 25).alias("length_sec"),
        F.round(F.col("l_discount") * 100).alias("rating"),
        "l_orderkey",
        "l_linenumber",
    )


ITEM_ORDER = ["l_orderkey", "l_linenumber", "title"]

ITEMS_SQL = f"""
items AS (SELECT p_brand AS entity_id, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' '
    || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' (' || p_type || ')' AS title,
  p_type AS artist, l_returnflag AS format, CASE WHEN p_size > 25 THEN 'Label ' || p_size END AS label,
  l_linestatus AS country, strftime(l_shipdate, '%Y') AS date, l_linenumber::VARCHAR AS catalog,
  l_quantity % 25 AS length_sec, round(l_discount * 100) AS rating, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey),
keyed AS (SELECT *, {S.variant_key('title')} AS title_key, (l_orderkey, l_linenumber, title) AS pos FROM items)
"""


def _set_sql(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), '|'), '')"


RELEASES_SQL = f"""SELECT entity_id, title_key, arg_min(title, pos) AS title, arg_min(artist, pos) AS artist,
  {_set_sql('format')} AS formats, {_set_sql('label')} AS labels, {_set_sql('country')} AS countries,
  {_set_sql('date')} AS dates, {_set_sql('catalog')} AS catalogs, '' AS barcodes,
  count(DISTINCT title)::INTEGER AS occurrences, {_set_sql('title')} AS variants
FROM keyed GROUP BY 1, 2"""

RECORDINGS_SQL = """SELECT entity_id, title_key, arg_min(title, pos) AS title,
  round_even(avg(nullif(length_sec, 0)), 2) AS avg_length_sec, round_even(avg(nullif(rating, 0)), 2) AS avg_rating,
  count(DISTINCT title)::INTEGER AS occurrences FROM keyed GROUP BY 1, 2"""

LISTS = ("formats", "labels", "countries", "dates", "catalogs", "barcodes", "variants")


@query("release_rollup", f"WITH {ITEMS_SQL} {RELEASES_SQL}")
def release_rollup(spark, sf):
    rolled = rollup.roll_up_releases(item_rows(spark, sf), order_by=ITEM_ORDER).drop("seen")
    return rolled.withColumns({c: F.array_join(c, "|") for c in LISTS})


@query(
    "release_values",
    f"""WITH {ITEMS_SQL} SELECT DISTINCT entity_id, title_key, list, value FROM keyed
  CROSS JOIN LATERAL (VALUES ('formats', format), ('labels', label), ('countries', country), ('dates', date),
    ('catalogs', catalog), ('variants', title)) AS v(list, value) WHERE value IS NOT NULL""",
)
def release_values(spark, sf):
    return rollup.value_rows(item_rows(spark, sf))


@query("recording_rollup", f"WITH {ITEMS_SQL} {RECORDINGS_SQL}")
def recording_rollup(spark, sf):
    return rollup.roll_up_recordings(item_rows(spark, sf), order_by=ITEM_ORDER).drop("seen", "variants")


@query(
    "assemble_nested",
    f"""WITH {ITEMS_SQL}, rel AS ({RELEASES_SQL}), rec AS ({RECORDINGS_SQL}),
brands AS (SELECT p_brand AS entity_id, count(*) AS n_parts FROM part GROUP BY 1)
SELECT b.*, coalesce((SELECT string_agg(title || '/' || occurrences || '/' || formats, ';' ORDER BY lower(title))
    FROM rel WHERE rel.entity_id = b.entity_id), '') AS releases,
  coalesce((SELECT string_agg(title || '/' || occurrences, ';' ORDER BY lower(title))
    FROM rec WHERE rec.entity_id = b.entity_id), '') AS recordings FROM brands b""",
)
def assemble_nested(spark, sf):
    rows = item_rows(spark, sf)
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_parts"))
    nested = rollup.assemble(
        brands,
        rollup.roll_up_releases(rows, order_by=ITEM_ORDER),
        rollup.roll_up_recordings(rows, order_by=ITEM_ORDER),
    )

    def shown(name: str, *fields: str):
        return F.array_join(
            F.transform(name, lambda r: F.concat_ws("/", *[
                F.array_join(r[f], "|") if f == "formats" else r[f].cast("string") for f in fields])), ";"
        ).alias(name)

    return nested.select(
        "entity_id", "n_parts", shown("releases", "title", "occurrences", "formats"), shown("recordings", "title", "occurrences")
    )
