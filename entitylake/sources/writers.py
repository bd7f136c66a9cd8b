"""Writers.  All overwrite their target folder unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from entitylake.functions.text import words
from entitylake.operators.blocks import (
    BLOCK_DOCS,
    BlockIndex,
    block_bounds,
    block_terms,
    block_totals,
    counted_fields,
    in_blocks,
    posting_blocks,
)
from entitylake.operators.entities import lookup_rows
from entitylake.operators.evaluate import compare, summary
from entitylake.operators.index import (
    BUCKETS,
    Tokenizer,
    bucket_of,
    count_terms,
    field_occurrences,
    field_totals,
    postings_of,
    term_table,
    with_idf,
    upsert_documents,
    upsert_stats,
)
from entitylake.operators.search import deletion_variants
from entitylake.sources.stage import release, staged


def write_json_lines(df: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """JSON lines; nulls are left out.  ``parts=1`` gives a single file, for small tables only."""
    (df if parts is None else df.coalesce(parts)).write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_sample(df: DataFrame, path: str, order_by: list[str], n: int = 100) -> None:
    """The first ``n`` rows as JSON lines for inspection."""
    df.orderBy(*order_by).limit(n).write.mode("overwrite").json(path)


def write_lookup(entities: DataFrame, path: str) -> None:
    """Tab-separated id, title, type and url, with a header."""
    lookup_rows(entities).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_ids(ids: DataFrame, path: str, key: str = "entity_id") -> None:
    """Sorted id list: range-partitioned, so the parts in name order are the sorted list.

    A list merged with its successor is written to a new folder, not over itself.
    """
    ids.select(key).distinct().orderBy(key).write.mode("overwrite").json(path)


def write_evaluation(judged: DataFrame, path: str, base: str, other: str) -> None:
    """Judged queries, the summary per method and the comparison, below ``path``."""
    write_json_lines(judged, f"{path}/queries")
    write_json_lines(summary(judged), f"{path}/methods")
    write_json_lines(compare(judged, base, other), f"{path}/comparison")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Index tables of ``docs(doc_id, name, text, ...)`` below ``path``.

    Postings lie in one folder per bucket of terms, sorted by term and document:
    a query with given terms, or a join with a few terms, reads the folders and
    row groups of those terms only.  Tasks get ranges of bucket, term and
    document, so a very frequent term spans several files instead of filling one.
    The texts are scanned once, for a staged table of term counts; postings (whose
    range bounds take a sample first) and document table are made from that, term
    statistics from the written postings.
    """
    counted = staged(count_terms(docs), owner=path)
    _write_tables(counted.drop("counts"), postings_of(counted), path, buckets)
    release(docs.sparkSession, owner=path)


def write_field_index(
    docs: DataFrame, path: str, fields: list[str], exact_fields: list[str] = (), buckets: int = BUCKETS
) -> None:
    """An index with positions of several fields: occurrences by field and bucket of terms, and totals.

    Laid out as in ``write_index``, with a folder per field above the buckets.
    """
    order = ["field", "bucket", "term", "doc_id", "pos"]
    rows = field_occurrences(docs, fields, exact_fields).withColumn("bucket", bucket_of("term", buckets))
    laid_out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid_out.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/occurrences")
    stored = docs.sparkSession.read.parquet(f"{path}/occurrences")
    field_totals(stored).write.mode("overwrite").parquet(f"{path}/totals")


def read_field_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, totals) as written by ``write_field_index``."""
    return spark.read.parquet(f"{path}/occurrences"), spark.read.parquet(f"{path}/totals")


def write_variants(terms: DataFrame, path: str) -> None:
    """The deletion variants of a vocabulary (``term``, ``df``), sorted so that given ones prune row groups."""
    rows = deletion_variants(terms.select("term", "df"))
    rows.repartitionByRange("variant", "term").sortWithinPartitions("variant", "term").write.mode("overwrite").parquet(path)


def write_block_index(
    docs: DataFrame,
    path: str,
    fields: list[str],
    exact_fields: list[str] = (),
    block_docs: int = BLOCK_DOCS,
    buckets: int = BUCKETS,
    tokenizer: Tokenizer = words,
) -> None:
    """An index in blocks with score bounds (``operators.blocks``) of several fields below ``path``.

    Term counts are staged once in blocks of documents; from there on only postings move.
    """
    spark = docs.sparkSession
    texts = in_blocks(docs.select(*dict.fromkeys(["doc_id", *fields, *exact_fields])), block_docs)
    counted = staged(counted_fields(texts, fields, exact_fields, tokenizer=tokenizer), owner=path)
    block_totals(counted).write.mode("overwrite").parquet(f"{path}/totals")
    laid_out = posting_blocks(counted, spark.read.parquet(f"{path}/totals"), buckets=buckets)
    laid_out.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/blocks")
    of_blocks = StructType([f for f in laid_out.schema if f.name not in ("field", "bucket")]).add("field", "string").add("bucket", "integer")
    block_bounds(spark.read.schema(of_blocks).parquet(f"{path}/blocks")).write.mode("overwrite").parquet(f"{path}/bounds")
    terms = block_terms(spark.read.parquet(f"{path}/bounds")).sortWithinPartitions("field", "term")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    release(spark, owner=path)


def _blocks(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """Posting blocks; their fields and buckets come from folders' names, of which there may be none."""
    postings = f"array<struct<doc_id:{doc_id},tf:int,doc_len:int>>"
    return spark.read.schema(f"term string, block int, postings {postings}, field string, bucket int").parquet(f"{path}/blocks")


def read_block_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BlockIndex:
    """The index as written by ``write_block_index``."""
    bounds, terms, totals = (spark.read.parquet(f"{path}/{t}") for t in ("bounds", "terms", "totals"))
    return BlockIndex(_blocks(spark, path, bounds.schema["first_doc"].dataType.simpleString()), bounds, terms, totals, buckets)


def update_index(docs: DataFrame, old: str, path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """The index below ``old`` with ``docs`` added or wholly replaced, written below ``path``.

    Only the new documents' texts are read; what is stored of replaced documents is
    dropped by id.  A new version without tokens is not indexed, so its document goes.
    Returns the numbers of documents added, replaced and removed, and the total.
    """
    spark = docs.sparkSession
    stored, posts, _ = read_index(spark, old)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    counted = staged(count_terms(docs), owner=path)
    merged = upsert_documents(posts.drop("bucket"), postings_of(counted), ids)
    kept = upsert_documents(stored, counted.drop("counts"), ids)
    _write_tables(kept, merged, path, buckets)
    counts = upsert_stats(stored, counted, ids).first().asDict()
    release(spark, owner=path)
    return counts


def refresh_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """The index below ``path`` with ``docs`` added or wholly replaced, in place.

    Only the bucket folders with a term that a changed document has or had are
    rewritten; all others keep their files.  Files are replaced where they lie: a refresh that
    stops half-way leaves an index to be built anew.  ``sources.segments`` refreshes without
    that risk.  Returns the counts of ``update_index`` and the number of folders rewritten.
    """
    spark = docs.sparkSession
    stored, posts, terms = read_index(spark, path)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    counted = staged(count_terms(docs), owner=path)
    coming = postings_of(counted).withColumn("bucket", bucket_of("term", buckets))
    going = posts.join(ids, "doc_id", "left_semi").select("bucket").distinct()
    touched = sorted(r["bucket"] for r in coming.select("bucket").distinct().union(going).distinct().collect())
    counts = upsert_stats(stored, counted, ids).first().asDict() | {"folders": len(touched)}

    here = F.col("bucket").isin(touched)
    order = ["bucket", "term", "doc_id"]
    fresh = upsert_documents(posts.where(here), coming.select(posts.columns), ids)
    fresh = staged(fresh.repartitionByRange(*order).sortWithinPartitions(*order), owner=path)
    kept = staged(upsert_documents(stored, counted.drop("counts"), ids), owner=path)
    changed = fresh.select("term").union(posts.where(here).select("term")).distinct()
    df = terms.select("term", "df").join(changed, "term", "left_anti").union(
        fresh.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    n_docs = kept.agg(F.count(F.lit(1))).scalar()
    renewed = staged(with_idf(df, n_docs), owner=path)

    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/postings")
    left = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
    for bucket in touched:
        if bucket not in left:  # nothing is written to a folder that lost all rows
            _delete(spark, f"{path}/postings/bucket={bucket}")
    kept.write.mode("overwrite").parquet(f"{path}/docs")
    renewed.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    release(spark, owner=path)
    return counts


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _write_tables(docs: DataFrame, posts: DataFrame, path: str, buckets: int) -> None:
    spark = docs.sparkSession
    order = ["bucket", "term", "doc_id"]
    laid_out = (
        posts.withColumn("bucket", bucket_of("term", buckets))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    stored_docs = spark.read.parquet(f"{path}/docs")
    stored_postings = spark.read.parquet(f"{path}/postings")
    n_docs = stored_docs.agg(F.count(F.lit(1))).scalar()
    terms = term_table(stored_postings, n_docs)
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(
        f"{path}/terms"
    )


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, postings, terms) as written by ``write_index``."""
    docs, posts, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms"))
    return docs, posts, terms
