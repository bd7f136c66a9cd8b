"""Declared schemas: nothing in this library infers one from data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions.binding import record

TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """A flat struct from ``name TYPE, ...``; unlike DDL parsing it needs no session."""
    fields = (f.split() for f in spec.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


RELEASE = _struct(
    "title STRING, artist STRING, formats ARRAY<STRING>, labels ARRAY<STRING>, "
    "countries ARRAY<STRING>, dates ARRAY<STRING>, catalogs ARRAY<STRING>, "
    "barcodes ARRAY<STRING>, occurrences INT, variants ARRAY<STRING>"
)
RECORDING = _struct(
    "title STRING, avg_length_sec DOUBLE, avg_rating DOUBLE, occurrences INT, "
    "variants ARRAY<STRING>"
)
PERSON = _struct("name STRING, details STRING, url STRING")
RELATIONSHIPS = (
    T.StructType()
    .add("members", T.ArrayType(PERSON))
    .add("original_members", T.ArrayType(PERSON))
    .add("artistic_directors", T.ArrayType(PERSON))
    .add("text_summary", T.StringType())
)
ARTIST = (
    _struct(
        "uuid STRING, name STRING, comment STRING, type STRING, founded STRING, "
        "founded_in STRING, area STRING, isni_code STRING, rating_percent STRING, "
        "rating_value DOUBLE, genres ARRAY<STRING>, other_tags ARRAY<STRING>, "
        "last_updated STRING, url STRING"
    )
    .add("releases", T.ArrayType(RELEASE))
    .add("recordings", T.ArrayType(RECORDING))
    .add("relationships", RELATIONSHIPS)
)
# The six infobox fields are optional; declaring them keeps fields that the first rows lack.
ENTITY = _struct(
    "id STRING, title STRING, type STRING, url STRING, categories ARRAY<STRING>, "
    "abstract STRING, genre STRING, origin STRING, years_active STRING, label STRING, "
    "members STRING, birth_name STRING"
)
JOINED = T.StructType(
    ARTIST.fields
    + [
        T.StructField({"type": "wiki_type", "url": "wiki_url"}.get(f.name, f.name), f.dataType)
        for f in ENTITY.fields
    ]
    + [T.StructField("name_norm", T.StringType()), T.StructField("title_norm", T.StringType())]
)
PAGE_STORE = _struct("entity_id STRING, kind STRING, page_no INT, html STRING")
TRUTH = _struct("query STRING, relevant STRING")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; absent ones, nested ones too, become typed nulls."""
    return df.select(
        *[_field(df.schema, F.col, f).alias(f.name) for f in schema.fields]
    )


def _field(have: T.StructType, get: Callable[[str], Column], want: T.StructField) -> Column:
    if want.name not in have.fieldNames():
        return F.lit(None).cast(want.dataType)
    return _fit(get(want.name), have[want.name].dataType, want.dataType)


def _fit(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        if isinstance(want.elementType, T.StructType):
            return F.transform(value, lambda v: _fit(v, have.elementType, want.elementType))
    elif isinstance(want, T.StructType) and isinstance(have, T.StructType):
        fields = {f.name: _field(have, value.getField, f) for f in want.fields}
        return F.when(value.isNotNull(), record(**fields))
    return value.cast(want)
