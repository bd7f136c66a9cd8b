"""Readers; every schema is declared, none is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from entitylake.schemas import ARTIST, ENTITY

# <folder>/<entity id>/<kind>[-p<page number>].html
PAGE_PATH = r"([^/]+)/([a-z]+)(?:-p(\d+))?\.html$"
BAD_RECORD = "_bad_record"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_artists(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of artist records, as ``jobs.parse`` writes them; any number per file."""
    return spark.read.schema(ARTIST).json(path)


def read_artist_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of pretty-printed JSON files, one record each.

    A file that holds anything else than one record fails the job when it is read:
    a second record would otherwise be lost without a word.
    """
    files = spark.read.text(path, wholetext=True)
    one = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), ArrayType(ARTIST), {"mode": "FAILFAST"})
    return files.select(F.inline(one))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of entity records; absent optional fields are null."""
    return spark.read.schema(ENTITY).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, leaving out blank and undecodable ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_lines_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with the raw text of undecodable ones in ``_bad_record``."""
    return (
        spark.read.schema(StructType(schema.fields).add(BAD_RECORD, "string"))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .json(path)
    )


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """``PAGE_STORE`` rows of HTML files ``<path>/<entity id>/<kind>[-pN].html``."""
    files = spark.read.text(f"{path}/*/*.html", wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(where, PAGE_PATH, 1).alias("entity_id"),
        F.regexp_extract(where, PAGE_PATH, 2).alias("kind"),
        F.coalesce(F.regexp_extract(where, PAGE_PATH, 3).try_cast("int"), F.lit(1)).alias("page_no"),
        F.col("value").alias("html"),
    )


def limited(df: DataFrame, n: int | None, order_by: list[str] | None = None) -> DataFrame:
    """The input cut to ``n`` rows for a trial run; with ``order_by`` always the same rows."""
    if n is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(n)
