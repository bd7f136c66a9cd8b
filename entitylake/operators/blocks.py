"""Ranked retrieval over posting blocks with score bounds.

Documents lie in blocks of neighbouring ids.  A term's postings in a block are one row,
and beside it stands the most that any of them can add to a score.  A query sums these
bounds per block, scores its most promising blocks in full, and then only those blocks
whose bound reaches the k-th score found there; all others are skipped unread.  The
result equals scoring everything.

A frequent term is many rows, one for each block, so it is never the key of one task.
The narrow table of bounds is joined by term and slice (a range of blocks), of which a
term's entry lists those it occurs in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import let, record
from entitylake.operators.index import BUCKETS, Tokenizer, bucket_of
from entitylake.operators.search import (
    DECIMALS,
    WEIGHTS,
    Totals,
    Weight,
    bm25_idf,
    bm25_norm,
    query_table_terms,
    query_terms,
    top_ranked,
)
from entitylake.sources.stage import staged

#: Documents of a block, about.
BLOCK_DOCS = 256
#: Blocks of a slice of the table of bounds.
SLICE_BLOCKS = 1 << 16
#: Blocks of a range that one task lays out, for each bucket.
RANGE_BLOCKS = 8


@dataclass(frozen=True)
class BlockIndex:
    """Tables of an index in blocks.

    ``blocks(field, bucket, term, block, postings)`` holds arrays of ``doc_id, tf, doc_len``;
    ``bounds(field, term, slice, block, first_doc, last_doc, n, max_tf, min_len, max_norm)``
    what is known of each; ``terms(field, term, df, slices)`` and ``totals(field, n_docs,
    total_len, n_blocks)`` sum them up.
    """

    blocks: DataFrame
    bounds: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int = BUCKETS

    def of(self, field: str) -> Totals:
        here = self.totals.where(F.col("field") == field)
        both = here.agg(F.struct(F.max("n_docs").alias("n"), F.max("total_len").alias("len"))).scalar()
        return Totals(both["n"], both["len"])


def counted_fields(
    docs: DataFrame, fields: Sequence[str], exact_fields: Sequence[str] = (), doc_id: str = "doc_id", tokenizer: Tokenizer = X.words
) -> DataFrame:
    """(doc_id, block, fields): the terms and length per field of documents in blocks, counted inside their rows.

    An exact field is a single term as it is; a field without terms is left out.
    """
    sides = [(f, tokenizer(F.coalesce(f, F.lit("")))) for f in fields]
    sides += [(f, F.filter(F.array(F.col(f).cast("string")), lambda x: x.isNotNull())) for f in exact_fields]

    def count(field: str, tokens: Column) -> Column:
        return let(tokens, lambda t: record(field=F.lit(field), doc_len=F.size(t), counts=X.term_counts(t)))

    filled = F.filter(F.array(*[count(f, tokens) for f, tokens in sides]), lambda c: c["doc_len"] > 0)
    return docs.select(doc_id, "block", filled.alias("fields"))


def in_blocks(docs: DataFrame, block_docs: int = BLOCK_DOCS, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``block``: ranges of ids with about so many documents each.

    What comes of it is to be written before it is read twice: the bounds of the ranges
    come from a sample.  Taking it computes all that stands before, so terms are counted
    behind it, where the blocks deal the work too.
    """
    blocks = docs.count() // block_docs + 1
    return docs.repartitionByRange(blocks, doc_id).withColumn("block", F.spark_partition_id())


def block_totals(counted: DataFrame) -> DataFrame:
    """(field, n_docs, total_len, n_blocks) of documents in blocks."""
    each = counted.select("block", F.inline("fields"))
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("total_len"), F.count_distinct("block").alias("n_blocks")
    )


def posting_blocks(counted: DataFrame, totals: DataFrame, doc_id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(field, bucket, term, block, postings) of documents in blocks with the bounds of each, ordered as they are stored.

    A row holds a block's documents at most.  Postings are shuffled once: a partition has
    whole ranges of blocks of a bucket, so a frequent term is in many of them.  ``max_norm``
    is the largest BM25 part short of the term's weight.
    """
    whole = totals.select("field", F.col("n_docs").alias("_n"), F.col("total_len").alias("_len"))
    each = counted.select(F.col(doc_id).alias("doc_id"), "block", F.inline("fields")).join(F.broadcast(whole), "field")  # a row per field
    posts = each.select("field", "block", "doc_id", "doc_len", "_n", "_len", F.inline("counts"))
    posts = posts.withColumns({"bucket": bucket_of("term", buckets), "_range": F.floor(F.col("block") / (RANGE_BLOCKS * buckets)).cast("int")})
    dealt = posts.repartition("field", "bucket", "_range")
    grouped = dealt.groupBy("field", "bucket", "term", "block", "_range").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "tf", "doc_len"))).alias("postings"),
        F.max("tf").alias("max_tf"),
        F.min("doc_len").alias("min_len"),
        F.max(bm25_norm(F.col("tf"), F.col("doc_len"), Totals(F.col("_n"), F.col("_len")))).alias("max_norm"),
    )
    rows = grouped.select(
        "field",
        "bucket",
        "term",
        "block",
        "postings",
        F.element_at("postings", 1)["doc_id"].alias("first_doc"),
        F.element_at("postings", -1)["doc_id"].alias("last_doc"),
        F.size("postings").alias("n"),
        "max_tf",
        "min_len",
        "max_norm",
    )
    return rows.sortWithinPartitions("field", "bucket", "term", "block")


def block_bounds(blocks: DataFrame) -> DataFrame:
    """The table of bounds of stored posting blocks; a partition has whole slices of terms, in order."""
    slice_ = F.floor(F.col("block") / SLICE_BLOCKS).cast("int").alias("slice")
    rows = blocks.select("field", "term", slice_, "block", "first_doc", "last_doc", "n", "max_tf", "min_len", "max_norm")
    return rows.repartition("field", "term", "slice").sortWithinPartitions("field", "term", "block")


def block_terms(bounds: DataFrame) -> DataFrame:
    """(field, term, df, slices): documents with a term and the slices of its blocks."""
    per_slice = bounds.groupBy("field", "term", "slice").agg(F.sum("n").alias("n"))
    return per_slice.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list("slice")).alias("slices"))


def _most(weight: str | Weight, totals: Totals) -> Column:
    """What one term can add in a block: every weight grows with tf and falls with the length."""
    if weight == "bm25":
        return bm25_idf(F.col("df"), totals.n_docs) * F.col("max_norm")
    weigh = WEIGHTS[weight] if isinstance(weight, str) else weight
    return weigh(F.col("max_tf"), F.col("df"), F.col("min_len"), totals)


def query_bounds(index: BlockIndex, asked: DataFrame, field: str, weight: str | Weight) -> DataFrame:
    """(query, block, bound, terms): per block that holds a term of the query, the most a document there can score.

    ``asked`` has (query, term, qtf, df, slices); ``terms`` lists those of the block, so
    that only their postings are opened.
    """
    here = index.bounds.where(F.col("field") == field).drop("field")
    sliced = asked.withColumn("slice", F.explode("slices"))
    part = F.col("qtf") * _most(weight, index.of(field))
    met = here.join(sliced, ["term", "slice"]).withColumn("part", part)
    return met.groupBy("query", "block").agg(
        F.sum("part").alias("bound"), F.collect_list(F.struct("term", "qtf", "df")).alias("terms")
    )


def score_blocks(index: BlockIndex, chosen: DataFrame, field: str, weight: str | Weight) -> DataFrame:
    """(query, doc_id, score) of all documents in the chosen (query, block, terms)."""
    weigh = WEIGHTS[weight] if isinstance(weight, str) else weight
    wanted = chosen.select("query", "block", F.inline("terms")).withColumn("bucket", bucket_of("term", index.buckets))
    # written, so that Spark knows whether they are few: then no postings are shuffled
    wanted = staged(wanted)
    here = index.blocks.where(F.col("field") == field)
    asked = staged(wanted.select("bucket", "term").distinct())
    opened = here.join(asked, ["bucket", "term"], "left_semi").join(wanted, ["bucket", "term", "block"])
    hits = opened.select("query", "qtf", "df", F.inline("postings"))
    part = F.col("qtf") * weigh(F.col("tf"), F.col("df"), F.col("doc_len"), index.of(field))
    scores = hits.groupBy("query", "doc_id").agg(F.sum(part).alias("score"))
    return scores.select("query", "doc_id", F.round("score", DECIMALS).alias("score"))


def asked_terms(index: BlockIndex, queries: Sequence[str] | DataFrame, field: str, tokenizer: Tokenizer) -> DataFrame:
    """(query, term, qtf, df, slices) of query texts or of a table of them; unknown terms are gone."""
    if isinstance(queries, DataFrame):
        wanted = query_table_terms(queries, tokenizer)
    else:
        wanted = query_terms(index.terms.sparkSession, queries, tokenizer)
    known = index.terms.where(F.col("field") == field).drop("field")
    # written, so that Spark knows whether they are few when they meet the bounds
    return staged(known.join(wanted.select("query", "term", "qtf"), "term"))


def promising(index: BlockIndex, bounds: DataFrame, field: str, weight: str | Weight, top: int) -> DataFrame:
    """Those of the query bounds that can hold one of the ``top`` documents of their query.

    A query's ``top`` blocks of the highest bounds hold at least ``top`` matches, if there
    are so many blocks; the k-th score among them is a floor that other blocks have to
    reach.  Where there are fewer matches there is no floor.
    """
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top).drop("_place")
    first = top_ranked(score_blocks(index, seeds, field, weight), top)
    floors = first.where(F.col("rank") == top).select("query", F.col("score").alias("floor"))
    # the sums of bounds and of scores differ in their last digits
    reach = F.col("floor").isNull() | (F.col("bound") + 10.0**-DECIMALS >= F.col("floor"))
    return bounds.join(floors, "query", "left").where(reach).drop("floor")


def search_blocks(
    index: BlockIndex,
    queries: Sequence[str] | DataFrame,
    field: str = "content",
    weight: str | Weight = "bm25",
    top: int = 10,
    tokenizer: Tokenizer = X.words,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """(query, rank, doc_id, score): as ``search_field``, reading only blocks that can hold a result.

    ``bounds`` are the ``query_bounds`` of these queries where the caller has written them.
    """
    if bounds is None:
        bounds = staged(query_bounds(index, asked_terms(index, queries, field, tokenizer), field, weight))
    chosen = promising(index, bounds, field, weight, top)
    return top_ranked(score_blocks(index, chosen, field, weight), top)
