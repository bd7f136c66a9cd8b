"""The stages as jobs: each reads files or tables, writes its result and returns counts.

A result is written once and counted while it is written, or from what was
written.  Executors may be lost at any time:
between stages the state is the written table, within one it is Spark's lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitylake.operators import html, link, quality, rollup
from entitylake.operators.classify import false_match
from entitylake.operators.documents import build_documents
from entitylake.operators.entities import DEFAULT_SITE, extract_entities
from entitylake.rules import FalseMatchRules, TypeRules
from entitylake.schemas import ARTIST, JOINED, RELATIONSHIPS, conform
from entitylake.sources import readers, writers
from entitylake.sources.dump import decode_pages, read_dump


def _counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def extract(
    spark: SparkSession,
    dump: str,
    out: str,
    lookup: str | None = None,
    limit: int | None = None,
    rules: TypeRules | None = None,
    site: str = DEFAULT_SITE,
) -> dict[str, int]:
    """Dump to entity records (JSON lines) and, if wanted, the lookup file.

    ``limit`` cuts the number of raw chunks for a trial run.  Returns the number
    of entities and of each type.
    """
    chunks = readers.limited(read_dump(spark, dump), limit)
    entities = extract_entities(decode_pages(chunks), rules, site)
    types = [name for name, _ in (rules or TypeRules()).types]
    counted, seen = _counted(
        entities,
        entities=F.count(F.lit(1)),
        **{t: F.count_if(F.col("type") == t) for t in types},
    )
    writers.write_json_lines(counted, out)
    if lookup is not None:
        writers.write_lookup(readers.read_entities(spark, out), lookup)
    return seen.get


def artists_of(pages: DataFrame, site: str) -> DataFrame:
    """``ARTIST`` records of a page store; entities without a profile page are left out.

    Pages count as read in the order of their file names.
    """

    def of(kind: str) -> DataFrame:
        chosen = pages.where(F.col("kind") == kind)
        return chosen.select("entity_id", F.col("page_no").cast("string").alias("page_no"), "html")

    profiles = html.profiles(of("profile").select("entity_id", "html"), site)
    related = of("relationships").select("entity_id", html.relationships("html", site).alias("relationships"))
    records = rollup.assemble(
        profiles,
        rollup.roll_up_releases(html.release_rows(of("releases"), site)),
        rollup.roll_up_recordings(html.recording_rows(of("recordings"), site)),
        related,
    )
    nobody = html.relationships(F.lit(None).cast("string"), site).cast(RELATIONSHIPS)
    return conform(records.withColumn("relationships", F.coalesce("relationships", nobody)), ARTIST)


def parse(spark: SparkSession, store: str, out: str, site: str) -> dict[str, int]:
    """HTML page store to one JSON line per artist; returns their number."""
    counted, seen = _counted(
        artists_of(readers.read_page_store(spark, store), site), parsed=F.count(F.lit(1))
    )
    writers.write_json_lines(counted, out)
    return seen.get


def join(
    artists: DataFrame,
    entities: DataFrame,
    out: str,
    sample: str | None = None,
    drop_empty_keys: bool = True,
) -> DataFrame:
    """Link both tables, write Parquet and an optional JSON sample; returns the statistics row.

    Both inputs are read several times, for the counts of their keys, the join and the
    statistics: give written tables.  Names without any letter or digit share the empty
    key and would all be linked with each other, so they are left out unless asked for.
    The statistics are computed from key counts, not from the joined rows.
    """
    joined = link.link(artists, entities, spread_left_by=["uuid"], spread_right_by=["id"], drop_empty_keys=drop_empty_keys)
    writers.write_parquet(conform(joined, JOINED), out)
    if sample is not None:
        written = readers.read_parquet(artists.sparkSession, out)
        writers.write_sample(written, sample, ["uuid", "id"])
    return link.link_stats(artists, entities)


def clean(
    spark: SparkSession,
    joined: str,
    out: str,
    order_by: list[str] = ("uuid", "id"),
    rules: FalseMatchRules | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Keep the first acceptable link of each artist (JSON lines); returns the summary row.

    ``order_by`` stands for the file order and must be unique.
    """
    records = readers.read_parquet(spark, joined)
    wrong = false_match("categories", rules)
    writers.write_json_lines(quality.dedupe(records, "uuid", list(order_by), wrong), out, parts)
    return quality.dedupe_summary(records, "uuid", list(order_by), wrong)


def build_index(records: DataFrame, out: str, site: str) -> None:
    """Index tables of linked records."""
    writers.write_index(build_documents(records, site), out)
