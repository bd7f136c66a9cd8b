"""Raw inputs that the tables do not hold, derived from them by column expressions.

The reference-shaped raw data (dump pages, HTML tables, nested records) is built
from table rows, so the work of a query grows with the tables, and its oracle
states the expected fields directly from the table columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import table

SITE = "https://music.example.org"


def text_of(*parts: Column | str) -> Column:
    """Concatenation of literals (str) and columns; null parts are left out."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def numbers(n: Column, most: int) -> Column:
    """1 .. n as an array, n at most ``most``."""
    return F.slice(F.sequence(F.lit(1), F.lit(most)), 1, n)


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents."""
    return spread(table(spark, sf, "documents").select("doc_id", *columns), "doc_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over as many partitions as the session's ``spark.entitylake.spread`` asks for.

    For tables of one small file, which is one task; unset, rows stay where they are.
    """
    partitions = df.sparkSession.conf.get("spark.entitylake.spread", None)
    return df.repartition(int(partitions), F.hash(key)) if partitions else df


#: Rows of a table that a task makes records of.
RECORD_ROWS = 10_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks of about ``RECORD_ROWS``; fewer than twice as many stay where they are.

    For narrow rows that much is made of: a file of a megabyte is one task, whatever comes of its rows.
    """
    tasks = df.count() // RECORD_ROWS
    return df.repartition(tasks) if tasks > 1 else df


# --- dump pages from documents ------------------------------------------------


def markup_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(title, text): every document as an encyclopedia page with infobox and categories."""
    docs = documents(spark, sf, "text", "lang", "source")
    c = F.col
    category = (
        F.when(c("lang") == "en", "Rock music bands")
        .when(c("lang") == "fr", "French musicians")
        .when(c("lang") == "de", "Computer software")
        .when(c("doc_id") % 2 == 0, "Album covers")
        .otherwise("Places in Spain")
    )
    text = text_of(
        "{{Infobox musical artist\n| name = Doc ", c("doc_id"),
        "\n| genre = [[Style of ", c("source"), "|", c("lang"), "]] music",
        "\n| birth_place = [[", c("source"), "]], ", c("lang"),
        "\n| years_active = 1990–2000<ref>n</ref>",
        "\n| label = <i>", c("source"), "</i> {{small|x}}",
        F.when(c("doc_id") % 2 == 0, text_of("\n| birth_name =   Name  ", c("doc_id"))),
        "\n}}\n\n", c("text"),
        "\n\n== History ==\nMore.\n\n[[Category:", category, "]]\n[[category: Pages of ", c("source"), "|key]]\n",
    )
    return docs.select("doc_id", text_of("Doc ", c("doc_id")).alias("title"), text.alias("text"))


MARKUP_SQL = r"""
pages_m AS (SELECT doc_id, 'Doc ' || doc_id AS title, lang, source,
  '{{Infobox musical artist' || chr(10) || '| name = Doc ' || doc_id || chr(10)
  || '| genre = [[Style of ' || source || '|' || lang || ']] music' || chr(10)
  || '| birth_place = [[' || source || ']], ' || lang || chr(10)
  || '| years_active = 1990–2000<ref>n</ref>' || chr(10)
  || '| label = <i>' || source || '</i> {{small|x}}'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '| birth_name =   Name  ' || doc_id ELSE '' END
  || chr(10) || '}}' || chr(10) || chr(10) || text || chr(10) || chr(10) || '== History ==' || chr(10)
  || 'More.' AS text FROM documents)
"""


def xml_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Dump chunks (up to, not including, the page end); every seventh page is cut off."""
    docs = documents(spark, sf, "text", "source")
    escaped = F.replace(
        F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")
    )
    whole = F.col("doc_id") % 7 != 3
    value = text_of(
        "<siteinfo><x>&y;</siteinfo>\n", F.when(F.col("doc_id") % 11 != 5, "  <page>\n"),
        "<title>", F.col("source"), " &amp; ", F.col("doc_id"),
        '</title><ns>0</ns><revision><id>1</id><text bytes="9" xml:space="preserve">',
        escaped, F.when(whole, "</text></revision>\n"),
    )
    return docs.select("doc_id", value.alias("value"))


# --- HTML from customers and parts --------------------------------------------


def uuid_of(c: Column) -> Column:
    h = F.md5(c.cast("string"))
    return F.concat_ws(
        "-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def uuid_sql(c: str) -> str:
    h = f"md5({c}::VARCHAR)"
    return f"concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32])"


def profile_pages(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    html = text_of(
        '<html>\n<a href="/artist/', uuid_of(k), '/works">w</a>\n<h1><a href="/x"><bdi>', F.col("c_name"),
        "</bdi></a></h1>\n",
        F.when(F.col("c_acctbal") < 0, '<span class="comment">(<bdi>in debt</bdi>)</span>\n'),
        '<dd class="type">', F.col("c_mktsegment"), "</dd>\n",
        F.when(k % 3 == 0, text_of("founded:  19", F.lpad(n.cast("string"), 2, "0"), "-05 in Town ", n, ", X\n")),
        "<dt>Area: Nation ", n, "</dt>\n",
        F.when(k % 5 == 0, text_of('<a href="https://isni.org/0000', k, 'X">i</a>\n')),
        '<span style="width:11%">1.1</span>\n',
        F.when(
            k % 4 != 1,
            text_of('<h2 class="rating">Rating</h2>\n<p>', F.when(
                k % 4 != 2, text_of('<span style="width:', n, '%">', n % 5, '.25</span>')), "</p>\n"),
        ),
        '<h3>Genres</h3><div class="genre-list">',
        F.when(k % 6 == 0, "(None)").otherwise(
            text_of('<a href="/t"> z', n, ' </a>, <a href="/t">', F.lower("c_mktsegment"), '</a>, <a href="/t">z', n, "</a>")
        ),
        "</div>\n",
        F.when(k % 7 != 0, text_of('<h3>Other tags</h3><div id="sidebar-tag-list"><a href="/t">o', n, "</a></div>\n")),
        '<p class="lastupdate">Last updated on 2024-01-', n, "</p></html>",
    )
    return table(spark, sf, "customer").select("c_custkey", html.alias("html"))


def release_pages(spark: SparkSession, sf: str) -> DataFrame:
    def row(i: Column) -> Column:
        return text_of(
            '<tr class="odd">\n<td><a class="wrap-anywhere" href="/release/', F.col("p_partkey"), "-", i, '"><bdi> ',
            F.col("p_name"), " (v", i, ')</bdi></a></td>\n<td><bdi><a href="/artist/x">', F.col("p_brand"),
            "</a></bdi></td><td>", F.when(i != 2, F.col("p_type")), "</td><td>", i + 2,
            '</td><td><abbr title="Land ', F.col("p_size"), '">L</abbr><span class="release-date">',
            F.when(i != 3, text_of("200", i, "-01")), '</span></td><td><a href="/label/1"><bdi>Label ', F.col("p_size"),
            "</bdi></a>", F.when(i == 1, '<span class="catalog-number">C-1</span>').otherwise(
                '</td><td><span class="catalog-number">lost</span>'),
            '</td><td class="barcode-cell">', F.when(i == 1, "[none]").otherwise(text_of(F.col("p_partkey"), i)), "</td></tr>\n",
        )

    rows = F.array_join(F.transform(numbers(F.col("p_size") % 4, 3), row), "")
    html = text_of("<table><tr><th>head</th></tr>\n", rows, "<tr>no cells</tr></table>")
    return table(spark, sf, "part").select("p_partkey", html.alias("html"))


def recording_pages(spark: SparkSession, sf: str) -> DataFrame:
    def row(i: Column) -> Column:
        return text_of(
            '<tr><td><a class="wrap-anywhere" href="/recording/', F.col("p_partkey"), "-", i, '"><bdi>',
            F.col("p_name"), " ", i, '</bdi></a></td><td><bdi><a href="/artist/x">', F.col("p_brand"), "</a></bdi></td>",
            F.when(i != 2, text_of('<td class="c"><span class="current-rating" style="width:80%">', i, ".5</span></td>")),
            "<td>", F.when(i != 3, text_of(i, ":0", F.col("p_size") % 10)).otherwise("?:??"),
            '</td><td>in <a href="/rg/1"><bdi>Group ', F.col("p_size"), "</bdi></a></td>\n",
        )

    rows = F.array_join(F.transform(numbers(F.col("p_size") % 5, 4), row), "")
    return table(spark, sf, "part").select("p_partkey", text_of("<table>", rows, "</table>").alias("html"))


def relationship_pages(spark: SparkSession, sf: str) -> DataFrame:
    def person(tail: str) -> Column:
        return text_of('<a title="t" href="/artist/', F.col("c_custkey"), tail, '"><bdi>', F.col("c_name"), tail, " </bdi></a>")

    html = text_of(
        '<table><tr><th class="a">Members:</th>\n<td>', person("a"), " (from 19", F.col("c_nationkey"), " to now), ",
        person("b"), " (later)</td></tr>",
        F.when(F.col("c_custkey") % 3 == 0, text_of("<tr><th>original members:</th><td>", person("c"), "</td></tr>")),
        "<tr><th>Associated acts:</th><td>", person("d"), "</td></tr></table>",
    )
    return table(spark, sf, "customer").select("c_custkey", html.alias("html"))


# --- linked records from parts -------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Linked records: one per part, with all the gaps the builders must fill."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")

    def release(i: Column) -> Column:
        return F.struct(
            F.when(i != 4, text_of("R", i, " of ", F.col("p_name"))).alias("title"),
            F.col("p_brand").alias("artist"),
            F.when(i % 2 == 0, F.array("p_type", F.lit("CD"))).otherwise(none).alias("formats"),
            F.when(i % 3 == 0, F.array(text_of("19", size))).otherwise(none).alias("dates"),
        )

    def recording(i: Column) -> Column:
        return F.struct(
            text_of("Song ", i).alias("title"),
            F.when(i % 3 != 0, i * F.lit(30.5)).alias("avg_length_sec"),
        )

    members = F.array(F.struct(text_of("M", k).alias("name")), F.struct(F.lit("Zed").alias("name")))
    return dealt(table(spark, sf, "part")).select(
        "p_partkey",
        F.when(k % 50 != 7, text_of("p", k)).alias("uuid"),
        F.when(k % 31 != 0, F.col("p_name")).alias("name"),
        text_of(F.col("p_name"), " ", F.col("p_brand")).alias("title"),
        F.when(k % 2 == 0, F.col("p_type")).alias("type"),
        F.when(k % 3 == 0, F.lit("band")).alias("wiki_type"),
        F.when(k % 4 == 0, text_of("Area ", size)).alias("area"),
        F.when(k % 8 != 1, text_of("Origin ", F.col("p_brand"))).alias("origin"),
        F.when(k % 5 == 0, F.array("p_type", F.lit("pop"))).otherwise(none).alias("genres"),
        F.when(k % 5 == 1, F.lit("punk")).alias("genre"),
        F.when(k % 2 == 1, F.transform(numbers(size % 13, 12), lambda i: text_of("Cat ", i, " ", F.col("p_brand")))).alias("categories"),
        F.when(k % 6 != 0, F.repeat(F.concat("p_name", F.lit(". ")), size)).alias("abstract"),
        F.when(k % 10 == 1, F.lit("1999")).when(k % 10 == 2, F.lit("Paris")).alias("founded_in"),
        F.when(k % 9 == 0, size / 10).alias("rating_value"),
        F.when(k % 3 == 1, F.lit("https://a.example.org/x")).alias("url"),
        F.when(k % 6 == 0, F.lit("https://b.example.org/y")).alias("wiki_url"),
        F.transform(numbers(size % 14, 13), release).alias("releases"),
        F.transform(numbers(size % 18, 17), recording).alias("recordings"),
        F.when(k % 3 == 0, F.struct(members.alias("members"))).alias("relationships"),
    )


RECORDS_SQL = """
records AS (SELECT p_partkey, p_brand, p_type, p_size,
  CASE WHEN p_partkey % 50 <> 7 THEN 'p' || p_partkey END AS uuid,
  CASE WHEN p_partkey % 31 <> 0 THEN p_name END AS name, p_name || ' ' || p_brand AS title,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type,
  CASE WHEN p_partkey % 3 = 0 THEN 'band' END AS wiki_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'Area ' || p_size END AS area,
  CASE WHEN p_partkey % 8 <> 1 THEN 'Origin ' || p_brand END AS origin,
  CASE WHEN p_partkey % 5 = 0 THEN [p_type, 'pop'] ELSE []::VARCHAR[] END AS genres,
  CASE WHEN p_partkey % 5 = 1 THEN 'punk' END AS genre,
  CASE WHEN p_partkey % 2 = 1 THEN [ 'Cat ' || i || ' ' || p_brand FOR i IN range(1, p_size % 13 + 1) ] END AS categories,
  CASE WHEN p_partkey % 6 <> 0 THEN repeat(p_name || '. ', p_size) END AS abstract,
  CASE p_partkey % 10 WHEN 1 THEN '1999' WHEN 2 THEN 'Paris' END AS founded_in,
  CASE WHEN p_partkey % 9 = 0 THEN p_size / 10.0 END AS rating_value,
  CASE WHEN p_partkey % 3 = 1 THEN 'https://a.example.org/x' END AS url,
  CASE WHEN p_partkey % 6 = 0 THEN 'https://b.example.org/y' END AS wiki_url,
  range(1, p_size % 14 + 1) AS rel, range(1, p_size % 18 + 1) AS rec,
  CASE WHEN p_partkey % 3 = 0 THEN ['M' || p_partkey, 'Zed'] END AS members, p_name
FROM part)
"""
