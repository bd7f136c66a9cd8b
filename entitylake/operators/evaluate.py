"""Top-1 relevance of ranked results against a table of relevant names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import let, record
from entitylake.operators.index import Tokenizer
from entitylake.sources.stage import staged

TIE = "tie"


def _phrase(tokens: Column) -> Column:
    """Tokens with a blank before, between and behind them, so that parts of words don't match."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def containing(
    queries: DataFrame,
    docs: DataFrame,
    query: str = "query",
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer = X.words,
    postings: DataFrame | None = None,
) -> DataFrame:
    """(query, relevant) for ``top1``: the documents that hold all tokens of a query in a row.

    A query that none holds has one row with null; one without tokens is in no document.
    Each query meets only the documents with its rarest token: those are an equi-join, and
    the texts of that few are then compared.  ``postings`` (``term``, ``doc_id``) by the same
    tokenizer save cutting the texts for the join.
    """
    asked = queries.select(F.col(query).alias("query")).where("query IS NOT NULL").distinct()
    cut = asked.select("query", let(tokenizer(F.col("query")), lambda t: record(phrase=_phrase(t), tokens=F.array_distinct(t))).alias("q"))
    asked_tokens = cut.select("query", F.explode("q.tokens").alias("token"))
    if postings is None:
        has = docs.select(F.col(doc_id).alias("_doc"), F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("token"))
    else:
        has = postings.select(F.col(doc_id).alias("_doc"), F.col("term").alias("token"))
    frequency = has.join(asked_tokens.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # a token that no document has rules its query out
    counted = asked_tokens.join(frequency, "token", "left")
    rarest = counted.groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("least"))
    anchors = rarest.where("least.df > 0").select("query", F.col("least.token").alias("token"))
    # written, so that Spark knows its size: few rows are then broadcast, and the texts are not shuffled
    near = staged(has.join(staged(anchors), "token").select("_doc", "query")).join(cut.select("query", "q.phrase"), "query")
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    held = near.join(texts, "_doc").where(F.contains(_phrase(tokenizer(F.col("_text"))), F.col("phrase")))
    found = held.select("query", F.col("_doc").cast("string").alias("relevant"))
    return asked.join(found, "query", "left")


def top1(results: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """(method, query, first_result, total_relevant, correct) for each method and query.

    ``results`` maps a method's name to its ranked rows (query, rank, name);
    ``truth(query, relevant)`` has one row per relevant name, with a null for a
    query that has none.  Without a result or a relevant name a query is not correct.
    """
    firsts = reduce(
        DataFrame.unionByName,
        [
            rows.where("rank = 1").select(
                F.lit(method).alias("method"), "query", F.col("name").alias("first_result")
            )
            for method, rows in results.items()
        ],
    )
    asked = (
        truth.groupBy("query")
        .agg(F.count("relevant").alias("total_relevant"))
        .select("*", F.explode(F.array(*map(F.lit, results))).alias("method"))
    )
    right = truth.select("query", F.col("relevant").alias("first_result"))
    hits = firsts.join(right, ["query", "first_result"], "left_semi").select(
        "method", "query", F.lit(True).alias("hit")
    )
    return (
        asked.join(firsts, ["method", "query"], "left")
        .join(hits, ["method", "query"], "left")
        .select(
            "method",
            "query",
            "first_result",
            "total_relevant",
            F.coalesce("hit", F.lit(False)).alias("correct"),
        )
    )


def summary(judged: DataFrame) -> DataFrame:
    """Accuracy, correct and total queries per method; precision@1 and recall@1 equal accuracy."""
    accuracy = F.avg(F.col("correct").cast("double"))
    return judged.groupBy("method").agg(
        F.round(accuracy, 6).alias("accuracy"),
        F.count_if("correct").alias("correct_count"),
        F.count(F.lit(1)).alias("total_queries"),
        F.round(accuracy, 6).alias("avg_precision"),
        F.round(accuracy, 6).alias("avg_recall"),
    )


def compare(judged: DataFrame, base: str, other: str) -> DataFrame:
    """One row: both accuracies, the winner and the relative improvement in percent.

    The improvement is 0 when the base has no correct answer.
    """

    def accuracy(method: str) -> Column:
        return F.avg(F.when(F.col("method") == method, F.col("correct").cast("double")))

    both = judged.agg(accuracy(base).alias("base_accuracy"), accuracy(other).alias("other_accuracy"))
    b, o = F.col("base_accuracy"), F.col("other_accuracy")
    winner = F.when(o > b, F.lit(other)).when(b > o, F.lit(base)).otherwise(F.lit(TIE))
    return both.select(
        F.round(b, 6).alias("base_accuracy"),
        F.round(o, 6).alias("other_accuracy"),
        winner.alias("winner"),
        F.round(F.when(b > 0, (o - b) / b * 100).otherwise(0.0), 6).alias("improvement"),
    )
