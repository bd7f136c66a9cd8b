"""Encyclopedia dump: one row per page out of an XML dump, plain or bzip2.

The text reader splits the file at every ``</page>``; both formats are
splittable, so one huge dump is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record

PAGE_START = "<page>"
PAGE_END = "</page>"
PAGE_TYPE = "title STRING, revision ARRAY<STRUCT<text: STRING>>"

# Used only where the page is not well-formed XML.
LOOSE_TITLE = r"(?s)<title>(.*?)</title>"
LOOSE_TEXT = r"(?s)<revision>.*?<text[^>]*>(.*?)(?:</text>|</page>|\z)"
# The first text of a page stands in its first revision; a self-closing one has none.
NO_FIRST_TEXT = r"(?s)\A(?:(?!<text[\s>/]).)*+<text(?:\s[^>]*)?/>"
REFERENCE = r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"
XML_ESCAPES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Raw chunks ``value``: the text before each page end (the last one is the file's tail)."""
    return spark.read.option("lineSep", PAGE_END).text(path)


def decode_pages(chunks: DataFrame, value: str = "value") -> DataFrame:
    """``title`` and ``text`` of each chunk.

    Chunks without a page, title or text are dropped.  Well-formed pages go
    through Spark's XML functions; a truncated page is salvaged by pattern.
    """
    raw = F.col(value)
    start = F.instr(raw, PAGE_START)
    xml = F.concat(F.substr(raw, start), F.lit(PAGE_END))
    return chunks.where(start > 0).select(keep_if(let(xml, _page), _is_complete))


def decode_quality(chunks: DataFrame, value: str = "value") -> DataFrame:
    """One row of counts: chunks, chunks with a page, decoded pages, rejected pages."""
    raw = F.col(value)
    start = F.instr(raw, PAGE_START)
    xml = F.concat(F.substr(raw, start), F.lit(PAGE_END))
    status = F.when(start > 0, let(let(xml, _page), _is_complete))
    return chunks.select(status.alias("decoded")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count("decoded").alias("pages"),
        F.count_if(F.col("decoded")).alias("decoded"),
        F.count_if(~F.col("decoded")).alias("rejected"),
    )


def _page(xml: Column) -> Column:
    strict = F.from_xml(xml, PAGE_TYPE, {"ignoreSurroundingSpaces": "false"})

    def pick(parsed: Column) -> Column:
        first = F.get(parsed["revision"], 0)["text"]
        text = F.coalesce(first, _unescape(X.first_match(xml, LOOSE_TEXT)))
        return record(
            title=F.coalesce(parsed["title"], _unescape(X.first_match(xml, LOOSE_TITLE))),
            text=F.when(~xml.rlike(NO_FIRST_TEXT), text),
        )

    return let(strict, pick)


def _is_complete(page: Column) -> Column:
    return (F.coalesce(page["title"], F.lit("")) != "") & (F.coalesce(page["text"], F.lit("")) != "")


def _character(reference: Column) -> Column:
    """The character of a numeric reference; one that names none is kept as it is."""
    code = F.coalesce(
        F.conv(F.nullif(F.regexp_extract(reference, REFERENCE, 1), F.lit("")), 16, 10),
        F.nullif(F.regexp_extract(reference, REFERENCE, 2), F.lit("")),
    ).cast("int")
    named = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)

    def utf8(code: Column) -> Column:
        tail = lambda shift: F.shiftright(code, shift).bitwiseAND(0x3F) + 0x80
        head = lambda shift, mark: F.shiftright(code, shift) + mark
        octets = (
            F.when(code < 0x80, F.array(code))
            .when(code < 0x800, F.array(head(6, 0xC0), tail(0)))
            .when(code < 0x10000, F.array(head(12, 0xE0), tail(6), tail(0)))
            .otherwise(F.array(head(18, 0xF0), tail(12), tail(6), tail(0)))
        )
        return F.decode(F.unhex(F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o), 2, "0")), "")), "UTF-8")

    return F.when(named, utf8(code)).otherwise(reference)


def _numeric(c: Column) -> Column:
    """Numeric references decoded: the text between them and the references take turns."""

    def decoded(text: Column) -> Column:
        between = F.split(text, REFERENCE)
        found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 0), _character)
        turns = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(found, i), F.lit(""))))
        return F.when(F.contains(text, F.lit("&#")), F.array_join(turns, "")).otherwise(text)

    return let(c, decoded)


def _unescape(c: Column) -> Column:
    c = _numeric(c)
    for escape, char in XML_ESCAPES.items():
        c = F.replace(c, F.lit(escape), F.lit(char))
    return c
