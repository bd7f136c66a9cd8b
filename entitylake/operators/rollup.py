"""Title variants rolled up into one record each, and records nested per entity.

Each roll-up is one aggregation: sets and minima are merged on the map side, so
what is shuffled per (entity, title key) is the distinct values, however many
rows repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import record
from entitylake.schemas import RECORDING, RELEASE

# Output list -> input column of the release roll-up.
RELEASE_SETS = {
    "formats": "format",
    "labels": "label",
    "countries": "country",
    "dates": "date",
    "catalogs": "catalog",
    "barcodes": "barcode",
}


def _sorted_set(name: str) -> Column:
    return F.sort_array(F.collect_set(name))


def _order(order_by: list[str]) -> Column:
    return F.struct(*order_by)


def roll_up_releases(
    rows: DataFrame,
    entity: list[str] = ("entity_id",),
    order_by: list[str] = ("page_no", "row_no"),
    sets: dict[str, str] = RELEASE_SETS,
) -> DataFrame:
    """One row per entity and title key.

    ``title`` and ``artist`` are those first seen in ``order_by``;
    ``occurrences`` counts distinct variants, not rows.
    """
    order = _order(list(order_by))
    return (
        rows.groupBy(*entity, X.variant_key("title").alias("title_key"))
        .agg(
            F.min_by(F.struct("title", "artist"), order).alias("first"),
            *[_sorted_set(column).alias(name) for name, column in sets.items()],
            _sorted_set("title").alias("variants"),
            F.min(order).alias("seen"),
        )
        .select(
            *entity,
            "title_key",
            "first.title",
            "first.artist",
            *sets,
            F.size("variants").alias("occurrences"),
            "variants",
            "seen",
        )
    )


def value_rows(
    rows: DataFrame, entity: list[str] = ("entity_id",), sets: dict[str, str] = RELEASE_SETS
) -> DataFrame:
    """The sets of the release roll-up in long form: (entity, title_key, list, value), each once.

    The form to keep where an entity may have any number of rows: nothing is
    gathered per entity, and repeated values are dropped before the shuffle.
    """
    listed = {**sets, "variants": "title"}
    values = F.array(
        *[record(list=F.lit(name), value=F.col(column).cast("string")) for name, column in listed.items()]
    )
    return (
        rows.select(*entity, X.variant_key("title").alias("title_key"), F.inline(values))
        .where(F.col("value").isNotNull())
        .distinct()
    )


def roll_up_recordings(
    rows: DataFrame,
    entity: list[str] = ("entity_id",),
    order_by: list[str] = ("page_no", "row_no"),
    length: str = "length_sec",
    rating: str = "rating",
) -> DataFrame:
    """One row per entity and title key with mean length and mean rating.

    Zero counts as missing in both means; they are rounded half-even to two decimals.
    """
    order = _order(list(order_by))

    def mean(name: str) -> Column:
        return F.bround(F.avg(F.when(F.col(name) != 0, F.col(name))), 2)

    return (
        rows.groupBy(*entity, X.variant_key("title").alias("title_key"))
        .agg(
            F.min_by("title", order).alias("title"),
            mean(length).alias("avg_length_sec"),
            mean(rating).alias("avg_rating"),
            _sorted_set("title").alias("variants"),
            F.min(order).alias("seen"),
        )
        .select(
            *entity,
            "title_key",
            "title",
            "avg_length_sec",
            "avg_rating",
            F.size("variants").alias("occurrences"),
            "variants",
            "seen",
        )
    )


def nest(rolled: DataFrame, entity: str, name: str, fields: list[str]) -> DataFrame:
    """One row per entity: its roll-up rows as an array sorted by lower-cased title.

    The array holds one entry per distinct title key of the entity, which the
    crawl's page cap bounds; unbounded lists stay in the long form given here as input.
    """
    entry = F.struct(*fields)
    keyed = F.struct(F.lower("title").alias("k"), F.col("seen").alias("s"), entry.alias("v"))
    return rolled.groupBy(entity).agg(
        F.transform(F.sort_array(F.collect_list(keyed)), lambda e: e["v"]).alias(name)
    )


def assemble(
    profiles: DataFrame,
    releases: DataFrame,
    recordings: DataFrame,
    relationships: DataFrame | None = None,
    entity: str = "entity_id",
) -> DataFrame:
    """Nested record per profile; entities without rows get empty arrays.

    All inputs are aggregated to one row per entity and joined on the same key,
    so Spark shuffles each side once at most.
    """
    record = profiles
    for rolled, name, fields in (
        (releases, "releases", [f for f in RELEASE.fieldNames() if f in releases.columns]),
        (recordings, "recordings", [f for f in RECORDING.fieldNames() if f in recordings.columns]),
    ):
        nested = nest(rolled, entity, name, fields)
        empty = F.array().cast(nested.schema[name].dataType)
        record = record.join(nested, entity, "left").withColumn(name, F.coalesce(name, empty))
    if relationships is not None:
        record = record.join(relationships, entity, "left")
    return record
