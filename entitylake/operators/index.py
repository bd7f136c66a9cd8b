"""Index tables: postings, document lengths, term statistics.

``postings(field, term, doc_id, tf, doc_len)`` is the inverted index in long form.
A document's terms are counted inside its row, so building postings needs no
shuffle; only their ordered layout on disk does (``sources.writers``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record

Tokenizer = Callable[[Column], Column]

BUCKETS = 256  # folders of the stored postings


def bucket_of(term: Column | str, buckets: int = BUCKETS) -> Column:
    """The folder of the stored postings that holds a term."""
    return F.pmod(F.xxhash64(X.col(term)), F.lit(buckets)).cast("int")


def count_terms(
    docs: DataFrame, text: str = "text", tokenizer: Tokenizer = X.tokens
) -> DataFrame:
    """Documents with ``doc_len`` and ``counts`` (array of term, tf) in place of the text.

    All index tables derive from this one pass over the texts; documents without
    tokens are left out.
    """
    counted = let(
        tokenizer(F.col(text)), lambda t: record(doc_len=F.size(t), counts=X.term_counts(t))
    )
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, keep_if(counted, lambda r: r["doc_len"] > 0))


def postings_of(counted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per term and document out of ``count_terms``."""
    return counted.select(doc_id, "doc_len", F.inline("counts")).select(
        doc_id, "term", "tf", "doc_len"
    )


def postings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Tokenizer = X.tokens
) -> DataFrame:
    """One row per term and document; documents without tokens have none."""
    return postings_of(count_terms(docs.select(doc_id, text), text, tokenizer), doc_id)


def field_postings(
    docs: DataFrame,
    fields: list[str],
    exact_fields: list[str] = (),
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """Postings of several fields in one pass; an exact field is a single term as it is."""
    sides = [
        record(field=F.lit(f), tokens=tokenizer(F.coalesce(f, F.lit(""))))
        for f in fields
    ] + [
        record(field=F.lit(f), tokens=F.array(F.col(f).cast("string")))
        for f in exact_fields
    ]
    each = docs.select(doc_id, F.inline(F.array(*sides)))
    return each.select(
        "field",
        doc_id,
        F.size("tokens").alias("doc_len"),
        F.inline(X.term_counts(F.col("tokens"))),
    ).select("field", "term", doc_id, "tf", "doc_len")


def field_occurrences(
    docs: DataFrame,
    fields: list[str],
    exact_fields: list[str] = (),
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """(field, term, doc_id, pos, doc_len): a row per occurrence of a term in a field.

    The stored form of an index with positions: term frequencies are counts of its
    rows, phrases are rows in a row.  One pass, without a shuffle.
    """
    sides = [record(field=F.lit(f), tokens=tokenizer(F.coalesce(f, F.lit("")))) for f in fields] + [
        record(field=F.lit(f), tokens=F.array(F.col(f).cast("string"))) for f in exact_fields
    ]
    each = docs.select(doc_id, F.inline(F.array(*sides)))
    found = each.select("field", doc_id, F.size("tokens").alias("doc_len"), F.posexplode("tokens").alias("pos", "term"))
    return found.where("term IS NOT NULL").select("field", "term", doc_id, "pos", "doc_len")


def field_totals(occurrences: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(field, n_docs, total_len) of an index with positions: one row per field.

    A document's length is taken from its first position, so nothing is made distinct.
    """
    first = F.col("pos") == 0
    return occurrences.where(first).groupBy("field").agg(F.count(doc_id).alias("n_docs"), F.sum("doc_len").alias("total_len"))


def positional_postings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Tokenizer = X.words
) -> DataFrame:
    """One row per token occurrence with its position, for phrase queries on an index."""
    return docs.select(doc_id, F.posexplode(tokenizer(F.col(text))).alias("pos", "term"))


def doc_lengths(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Tokenizer = X.tokens
) -> DataFrame:
    """Kept tokens per document; documents without any are left out."""
    length = record(doc_len=F.size(tokenizer(F.col(text))))
    return docs.select(doc_id, keep_if(length, lambda r: r["doc_len"] > 0))


def term_table(postings: DataFrame, n_docs: Column, by: list[str] = ("term",)) -> DataFrame:
    """Document frequency and both inverse document frequencies (base 10) per term.

    ``n_docs`` is a scalar, e.g. ``lengths.agg(count(lit(1))).scalar()``.
    """
    return with_idf(postings.groupBy(*by).agg(F.count(F.lit(1)).alias("df")), n_docs)


def with_idf(df: DataFrame, n_docs: Column) -> DataFrame:
    """Document frequencies with both inverse document frequencies."""
    return df.select(
        "*",
        F.log10(n_docs / F.col("df")).alias("idf_basic"),
        F.log10(1 + n_docs / (1 + F.col("df"))).alias("idf_smooth"),
    )


def terms_of_texts(
    docs: DataFrame, text: str = "text", tokenizer: Tokenizer = X.tokens
) -> DataFrame:
    """``term_table`` straight from texts, in one scan.

    Every document adds one row for each distinct term and one for the empty
    term, whose count is the number of documents.  That count and the terms are
    both read from the same exchange of partial counts; no filter stands between,
    which would be pushed below it and make two different scans of them.
    """

    def with_total(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.concat(terms, F.array(F.lit(""))))

    distinct = let(let(tokenizer(F.col(text)), F.array_distinct), with_total)
    counts = (
        docs.select(F.explode(distinct).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    n_docs = counts.agg(F.max(F.when(F.col("term") == "", F.col("df")))).scalar()
    real = counts.select(
        keep_if(record(term=F.col("term"), df=F.col("df")), lambda r: r["term"] != "")
    )
    return real.select(
        "term",
        "df",
        F.log10(n_docs / F.col("df")).alias("idf_basic"),
        F.log10(1 + n_docs / (1 + F.col("df"))).alias("idf_smooth"),
    )


def upsert_documents(
    old: DataFrame, new: DataFrame, ids: DataFrame | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """``old`` with the documents of ``new`` added or wholly replaced.

    Also right for postings: all rows of a replaced document go, including those
    of terms it no longer has.  ``new`` may repeat an id (postings do).  ``ids``
    lists all documents that come, also those of which nothing is left to store:
    their old rows go as well.
    """
    coming = new.select(doc_id).distinct() if ids is None else ids.select(doc_id)
    return old.join(coming, doc_id, "left_anti").unionByName(new)


def upsert_stats(
    old: DataFrame, new: DataFrame, ids: DataFrame | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """One row: documents added, replaced and removed, and the total afterwards."""

    def marks(df: DataFrame, name: str) -> DataFrame:
        return df.select(doc_id, *[F.lit(n == name).alias(n) for n in ("was", "comes", "named")])

    rows = marks(old, "was").unionAll(marks(new, "comes")).unionAll(marks(new if ids is None else ids, "named"))
    per_id = rows.groupBy(doc_id).agg(*[F.bool_or(n).alias(n) for n in ("was", "comes", "named")])
    was, comes, gone = F.col("was"), F.col("comes"), F.col("named") & ~F.col("comes")
    return per_id.agg(
        F.count_if(~was & comes).alias("added"),
        F.count_if(was & comes).alias("replaced"),
        F.count_if(was & gone).alias("removed"),
        F.count_if(comes | (was & ~gone)).alias("total"),
    )
