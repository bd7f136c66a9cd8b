"""Looking at records: lookups, samples and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.operators.documents import first_filled

# Sizes and defaults of the display projections.
PROFILE_RELEASES = 10
PROFILE_RECORDINGS = 15
PROFILE_CATEGORIES = 10
SNIPPET = 200
UNKNOWN = "Unknown"
UNKNOWN_DATE = "Unknown date"
UNKNOWN_FORMAT = "Unknown format"
NOT_AVAILABLE = "N/A"


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in the given order: a distributed top-n, not a full sort."""
    return df.orderBy(*order_by).limit(n)


def lookup(df: DataFrame, name: str, order_by: list[str], column: str = "name") -> DataFrame:
    """The first row whose name equals ``name``, ignoring case."""
    return df.where(F.lower(column) == F.lower(F.lit(name))).orderBy(*order_by).limit(1)


def name_contains(df: DataFrame, part: str, column: str = "name") -> DataFrame:
    """Rows whose name contains ``part``, ignoring case."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(part))))


def labelled(df: DataFrame, names: list[str], template: str, *columns: str, column: str = "name") -> DataFrame:
    """Rows whose name is listed, with a ``label`` formatted from ``columns``."""
    return df.where(F.col(column).isin(*names)).select(
        "*", F.format_string(template, *[F.col(c) for c in columns]).alias("label")
    )


def random_sample(df: DataFrame, n: int, seed: int | None = None, key: str | None = None) -> DataFrame:
    """``n`` rows without replacement, all rows if there are fewer.

    With ``seed`` and ``key`` the choice depends only on them, whatever the partitioning.
    """
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def titles_only(array: str) -> Column:
    """The titles of an array of records; an empty or missing array stays as it is."""
    return F.transform(array, lambda r: F.coalesce(r["title"], F.lit(UNKNOWN)))


def simplify(df: DataFrame) -> DataFrame:
    """Releases and recordings reduced to their titles."""
    return df.withColumns({c: titles_only(c) for c in ("releases", "recordings")})


def size_of(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def more_than(array: str, shown: int) -> Column:
    """How many entries a list cut to ``shown`` leaves out."""
    return F.greatest(size_of(array) - shown, F.lit(0))


def release_lines(array: str = "releases", shown: int = PROFILE_RELEASES) -> Column:
    """(title, date, format) of the first releases, with defaults for missing ones."""
    return F.transform(
        F.slice(array, 1, shown),
        lambda r: F.struct(
            F.coalesce(r["title"], F.lit(UNKNOWN)).alias("title"),
            F.coalesce(F.get(r["dates"], 0), F.lit(UNKNOWN_DATE)).alias("date"),
            F.coalesce(F.get(r["formats"], 0), F.lit(UNKNOWN_FORMAT)).alias("format"),
        ),
    )


def recording_lines(array: str = "recordings", shown: int = PROFILE_RECORDINGS) -> Column:
    """(title, length as m:ss) of the first recordings."""
    return F.transform(
        F.slice(array, 1, shown),
        lambda r: F.struct(
            F.coalesce(r["title"], F.lit(UNKNOWN)).alias("title"),
            X.clock_text(r["avg_length_sec"]).alias("length"),
        ),
    )


def profile(df: DataFrame) -> DataFrame:
    """The profile view: scalars, first releases, recordings and categories, counts, members."""
    return df.select(
        "uuid",
        "name",
        "title",
        "type",
        "wiki_type",
        release_lines().alias("release_lines"),
        more_than("releases", PROFILE_RELEASES).alias("more_releases"),
        recording_lines().alias("recording_lines"),
        more_than("recordings", PROFILE_RECORDINGS).alias("more_recordings"),
        F.slice("categories", 1, PROFILE_CATEGORIES).alias("first_categories"),
        more_than("categories", PROFILE_CATEGORIES).alias("more_categories"),
        F.transform("relationships.members", lambda m: F.coalesce(m["name"], F.lit(UNKNOWN))).alias(
            "member_names"
        ),
        size_of("releases").alias("n_releases"),
        size_of("recordings").alias("n_recordings"),
    )


def snippet(c: Column | str, length: int = SNIPPET) -> Column:
    text = X.col(c)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def compact(df: DataFrame) -> DataFrame:
    """The compact view: place, genres and a snippet of the abstract, with fallbacks."""
    missing = F.lit(NOT_AVAILABLE)
    return df.select(
        "uuid",
        "name",
        "title",
        F.coalesce("area", "origin", missing).alias("place"),
        first_filled(F.array_join("genres", ", "), F.coalesce("genre", missing)).alias("genres"),
        snippet("abstract").alias("abstract"),
        size_of("releases").alias("n_releases"),
        size_of("recordings").alias("n_recordings"),
    )
