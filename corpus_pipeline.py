"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and is
written before the next begins; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import decontaminate, lines, packing, quality, shingles
from entitylake.sources.stage import release, staged

#: Score from which a document is kept, as the classifier's own prediction has it.
QUALITY = 0.7
OWNER = "pipeline"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from the labelled documents of the raw corpus, none of the held-out fold.
    Without labels it accepts everything.
    """
    model = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.trained:
        return docs
    return quality.scored(docs, model, score="_score").where(F.col("_score") >= QUALITY).drop("_score")


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; ``n_chars`` is that of the text left."""
    release(spark)
    kept = lines.without_repeats(docs)
    left = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", left).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least id, any row of it.

    Documents are linked by a Jaccard similarity of 0.8 of their five-word shingles.
    Rows without an id and rows repeated under one id are members of their group like
    others; a row without an id stays only where no row of its group has one.
    """
    release(spark)
    # written with the numbers, so that both scans see the same ones
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = staged(shingles.similar_groups(rows.select("_row", "doc_id", "text"), row="_row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    # written, so that Spark knows its size: the rows of a large group are then split or meet it by broadcast
    kept = staged(groups.groupBy("component").agg(F.min(order).getField("_row").alias("kept")))
    # written as well: few enough rows are broadcast, and no text is shuffled
    others = staged(groups.join(kept, "component").where(F.col("_row") != F.col("kept")).select("_row"))
    return rows.join(others, "_row", "left_anti").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    release(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    release(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", sequences),
]

#: SQL has no classifier and no tokenizer; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next."""
    release(spark, OWNER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), OWNER)
    return STAGES[-1][1](spark, docs, sf_dir)
