"""Text cleaning, tokens, durations and encyclopedia pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings import sqltext as S
from bindings.derived import MARKUP_SQL, documents, markup_pages, text_of, xml_chunks
from entitylake.functions import markup
from entitylake.functions import text as X
from entitylake.operators.entities import extract_entities
from entitylake.sources.dump import decode_pages, decode_quality
from entitylake.sources.readers import limited

LIST_ITEM = r'<li><a href="[^"]*">([^<]*)</a>'
SITE = "https://wiki.example.org/"


@query(
    "limit_scan",
    "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100",
)
def limit_scan(spark, sf):
    return limited(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), 100, ["doc_id"])


@query(
    "extract_tags",
    f"""SELECT page_id, array_to_string(list_transform(
  regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: {S.strip('x')}), '|') AS tags FROM pages""",
)
def extract_tags(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.array_join(markup.tagged_values("html", LIST_ITEM), "|").alias("tags"))


CATEGORY_SQL = """CASE lang WHEN 'en' THEN 'Rock music bands' WHEN 'fr' THEN 'French musicians'
  WHEN 'de' THEN 'Computer software'
  ELSE CASE WHEN doc_id % 2 = 0 THEN 'Album covers' ELSE 'Places in Spain' END END"""


@query(
    "extract_categories",
    f"SELECT doc_id, {CATEGORY_SQL} || '|Pages of ' || source AS categories FROM documents",
)
def extract_categories(spark, sf):
    pages = markup_pages(spark, sf)
    return pages.select("doc_id", F.array_join(markup.categories("text"), "|").alias("categories"))


CLEANED_SQL = S.squeeze(
    S.drop(S.link_labels("raw"), r"\{\{[^\}]+\}\}", "<[^>]+>", "(?s)<ref[^>]*>.*?</ref>")
)


@query(
    "clean_markup",
    f"""WITH v AS (SELECT doc_id, '[[' || source || '|label]] {{{{drop {{me}}}} [[' || lang || ']]<br/><ref name="a">kept</ref>'
  || text AS raw FROM documents) SELECT doc_id, nullif({CLEANED_SQL}, '') AS clean FROM v""",
)
def clean_markup(spark, sf):
    docs = documents(spark, sf, "text", "lang", "source")
    raw = text_of(
        "[[", F.col("source"), "|label]] {{drop {me}} [[", F.col("lang"), ']]<br/><ref name="a">kept</ref>', F.col("text")
    )
    return docs.select("doc_id", markup.clean_value(raw).alias("clean"))


@query(
    "clean_lists",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_brand
  WHEN p_size % 3 = 1 THEN p_type END AS items FROM part""",
)
def clean_lists(spark, sf):
    parts = table(spark, sf, "part")
    raw = (
        F.when(F.col("p_size") % 3 == 0, text_of("{{HList |[[", F.col("p_name"), "]]| |<b>", F.col("p_brand"), "</b> }} "))
        .when(F.col("p_size") % 3 == 1, text_of("{{flatlist|", F.col("p_type"), "}}"))
        .otherwise("{{nothing|left}}")
    )
    return parts.select("p_partkey", F.array_join(markup.clean_list(raw), "|").alias("items"))


@query(
    "infobox_fields",
    """SELECT doc_id, '[[Style of ' || source AS genre, source || ', ' || lang AS origin,
  '1990–2000n' AS years_active, source || ' {{small' AS label, NULL::VARCHAR AS members,
  CASE WHEN doc_id % 2 = 0 THEN 'Name ' || doc_id END AS birth_name FROM documents""",
)
def infobox_fields(spark, sf):
    return markup_pages(spark, sf).select("doc_id", F.inline(F.array(markup.infobox_fields("text"))))


@query(
    "infobox_fields_whole",
    """SELECT doc_id, lang || ' music' AS genre, source || ', ' || lang AS origin,
  '1990–2000n' AS years_active, source AS label, 'Ann; ' || source || '; ' || lang AS members,
  CASE WHEN doc_id % 2 = 0 THEN 'Name ' || doc_id END AS birth_name FROM documents""",
)
def infobox_fields_whole(spark, sf):
    """Values read over links and templates; a horizontal list gives several."""
    docs = markup_pages(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    listed = text_of("\n| members = {{hlist|[[Ann]]|", F.col("source"), "|<b>", F.col("lang"), "</b>}}\n| label =")
    text = F.replace("text", F.lit("\n| label ="), listed)
    fields = docs.select("doc_id", F.inline(F.array(markup.infobox_fields(text, whole_templates=True))))
    return fields.select("doc_id", *[F.array_join(c, "; ").alias(c) for c in fields.columns if c != "doc_id"])


LINE_SQL = S.squeeze(
    S.drop(
        S.link_labels("line"),
        "''{2,}",
        "(?s)<ref[^>]*>.*?</ref>",
        r"\{\{[Cc]ite[^}]*\}\}",
        r"\{\{[Ee]fn[^}]*\}\}",
        "<[^>]+>",
        r"\{\{[^\}]+\}\}",
    )
)
ABSTRACT_SQL = rf"""
{MARKUP_SQL},
split_lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM pages_m)),
depths AS (SELECT *, sum((length(line) - length(replace(line, '{{{{', ''))) / 2
    - (length(line) - length(replace(line, '}}}}', ''))) / 2) OVER (PARTITION BY doc_id ORDER BY i) AS depth,
  {LINE_SQL} AS clean FROM split_lines),
kinds AS (SELECT *, CASE WHEN depth > 0 THEN 'skip' WHEN starts_with(line, '==') THEN 'stop'
    WHEN regexp_matches(line, '^(\{{\{{|\[\[|\||#)') OR regexp_matches(clean, '^(\}}\}}|\|)') THEN 'skip'
    WHEN clean <> '' THEN 'text' ELSE 'blank' END AS kind FROM depths),
runs AS (SELECT *, sum(CASE WHEN kind = 'text' THEN length(clean) + 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS run FROM kinds),
ends AS (SELECT doc_id, min(i) AS last_line FROM runs
  WHERE kind = 'stop' OR (kind = 'blank' AND run > 0) OR (kind = 'text' AND run - 1 > 500) GROUP BY 1),
abstracts AS (SELECT m.doc_id, {S.strip(r"regexp_replace(coalesce(a.t, ''), '\}\}+', '', 'g')")} AS abstract
  FROM pages_m m LEFT JOIN (SELECT r.doc_id, string_agg(clean, ' ' ORDER BY i) AS t FROM runs r
    JOIN ends e ON r.doc_id = e.doc_id AND r.i <= e.last_line WHERE kind = 'text' GROUP BY 1) a
  ON m.doc_id = a.doc_id)
"""


@query("abstracts", f"WITH {ABSTRACT_SQL} SELECT * FROM abstracts")
def abstracts(spark, sf):
    return markup_pages(spark, sf).select("doc_id", markup.abstract("text").alias("abstract"))


@query(
    "wiki_entities",
    f"""WITH {ABSTRACT_SQL} SELECT 'Doc_' || d.doc_id AS id, 'Doc ' || d.doc_id AS title,
  CASE WHEN lang = 'en' THEN 'band' ELSE 'artist' END AS type, '{SITE}Doc_' || d.doc_id AS url,
  {CATEGORY_SQL.replace('doc_id', 'd.doc_id')} || '|Pages of ' || source AS categories, abstract,
  '[[Style of ' || source AS genre, source || ', ' || lang AS origin, '1990–2000n' AS years_active,
  source || ' {{{{small' AS label, NULL::VARCHAR AS members,
  CASE WHEN d.doc_id % 2 = 0 THEN 'Name ' || d.doc_id END AS birth_name
FROM documents d JOIN abstracts a ON d.doc_id = a.doc_id
WHERE lang IN ('en', 'fr') OR (lang = 'es' AND d.doc_id % 2 = 0)""",
)
def wiki_entities(spark, sf):
    entities = extract_entities(markup_pages(spark, sf), site=SITE)
    return entities.withColumn("categories", F.array_join("categories", "|"))


@query(
    "page_decode",
    "SELECT source || ' & ' || doc_id AS title, text FROM documents WHERE doc_id % 11 <> 5",
)
def page_decode(spark, sf):
    return decode_pages(xml_chunks(spark, sf).select("value"))


@query(
    "page_decode_quality",
    """SELECT count(*) AS chunks, count(*) FILTER (doc_id % 11 <> 5) AS pages,
  count(*) FILTER (doc_id % 11 <> 5) AS decoded, 0::BIGINT AS rejected FROM documents""",
)
def page_decode_quality(spark, sf):
    return decode_quality(xml_chunks(spark, sf))


# --- tokens and durations -------------------------------------------------------


@query(
    "tokenize",
    f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents",
)
def tokenize(spark, sf):
    docs = documents(spark, sf, "text")
    return docs.select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


@query(
    "tokenize_std",
    f"SELECT doc_id, array_to_string({S.words('text')}, ' ') AS words FROM documents",
)
def tokenize_std(spark, sf):
    docs = documents(spark, sf, "text")
    return docs.select("doc_id", F.array_join(X.words("text"), " ").alias("words"))


CLOCK_SQL = """l_quantity::INT || ':' || lpad((l_linenumber * 7)::VARCHAR, 2, '0')
  || CASE WHEN l_partkey % 5 = 0 THEN ':59' ELSE '' END"""


@query(
    "parse_duration",
    f"""SELECT l_orderkey, l_linenumber, {CLOCK_SQL} AS clock,
  CASE WHEN l_partkey % 9 <> 0 THEN l_quantity::INT * 60 + l_linenumber * 7 END AS seconds FROM lineitem""",
)
def parse_duration(spark, sf):
    items = table(spark, sf, "lineitem")
    clock = text_of(
        F.col("l_quantity").cast("int"), ":", F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0"),
        F.when(F.col("l_partkey") % 5 == 0, ":59"),
    )
    shown = F.when(F.col("l_partkey") % 9 != 0, clock).otherwise("?:??")
    return items.select(
        "l_orderkey", "l_linenumber", clock.alias("clock"), X.clock_seconds(shown).alias("seconds")
    )


@query(
    "format_duration",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN '?'
  ELSE floor(l_extendedprice / 60)::BIGINT || ':' || lpad((floor(l_extendedprice)::BIGINT % 60)::VARCHAR, 2, '0') END AS clock
FROM lineitem""",
)
def format_duration(spark, sf):
    items = table(spark, sf, "lineitem")
    seconds = F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")).when(F.col("l_partkey") % 2 == 0, 0.0)
    return items.select("l_orderkey", "l_linenumber", X.clock_text(seconds).alias("clock"))
