"""A stored index that is refreshed by adding segments and never by overwriting.

Below the index's path:

    segments/<name>/postings, docs, terms   the documents that one refresh brought
    segments/<name>/dead                    rows of earlier segments that it replaced
    segments/<name>/lost                    what those rows had counted, per term
    manifests/<version>                     the segments of a version, by age

Every refresh writes a segment under a new name and, last of all, the next manifest, whose
``_SUCCESS`` file appears when it is whole.  Readers take the newest whole manifest, so a
writer that stops anywhere leaves the version before it in use, and its half-written
segment is nobody's.  ``merge`` writes all living rows as one segment, ``clean`` removes
what no kept version names.  One writer at a time: of two, the second fails when it writes
the manifest that the first has written.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.operators.index import BUCKETS, Tokenizer, bucket_of, count_terms, postings_of, upsert_stats, with_idf
from entitylake.sources.stage import release, staged

MANIFEST = "segment string, age int"


def _path(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of an index, oldest first."""
    whole = []
    for name in _children(spark, f"{path}/manifests"):
        fs, done = _path(spark, f"{path}/manifests/{name}/_SUCCESS")
        if name.isdigit() and fs.exists(done):
            whole.append(int(name))
    return whole


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The segments of a version, oldest first; of none there are none.  A row per refresh since the last merge."""
    known = versions(spark, path)
    if version is None and not known:
        return []
    at = known[-1] if version is None else version
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifests/{at:010d}").collect()
    return [r["segment"] for r in sorted(rows, key=lambda r: r["age"])]


def _write(df: DataFrame, folder: str) -> None:
    """All that is ever written goes to folders that did not exist before."""
    df.write.mode("error").parquet(folder)


def _publish(spark: SparkSession, path: str, names: list[str]) -> int:
    version = max([int(n) for n in _children(spark, f"{path}/manifests") if n.isdigit()], default=0) + 1
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], MANIFEST).coalesce(1)
    rows.write.mode("error").json(f"{path}/manifests/{version:010d}")
    return version


def _each(spark: SparkSession, path: str, names: list[str], table: str) -> DataFrame:
    """A table of several segments with the age of each row's segment."""
    found = None
    for age, name in enumerate(names):
        rows = spark.read.parquet(f"{path}/segments/{name}/{table}").withColumn("age", F.lit(age))
        found = rows if found is None else found.unionByName(rows)
    return found


def _living(spark: SparkSession, path: str, names: list[str], table: str) -> DataFrame:
    """Rows of ``docs`` or ``postings`` that no later segment replaced.

    Only the ids of replaced rows are joined; they are few between two merges, and Spark
    broadcasts them by their size.
    """
    rows = _each(spark, path, names, table)
    if len(names) == 1:
        return rows
    dead = _each(spark, path, names, "dead").select("doc_id", F.col("of").alias("segment")).distinct()
    marked = rows.withColumn("segment", F.element_at(F.array(*map(F.lit, names)), F.col("age") + 1))
    return marked.join(dead, ["doc_id", "segment"], "left_anti").drop("segment")


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, postings, terms) of the newest whole version or of an older one, as ``writers.read_index`` gives them."""
    names = segments(spark, path, version)
    if not names:
        raise FileNotFoundError(f"no whole version of an index below {path}")
    docs = _living(spark, path, names, "docs").drop("age")
    posts = _living(spark, path, names, "postings").drop("age")
    counts = _each(spark, path, names, "terms").select("term", "df")
    if len(names) > 1:
        counts = counts.unionByName(_each(spark, path, names, "lost").select("term", (-F.col("df")).alias("df")))
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return docs, posts, with_idf(counts, n_docs)


def _write_segment(path: str, name: str, docs: DataFrame, posts: DataFrame, buckets: int) -> None:
    """Postings sorted by bucket, term and document, so that given terms prune row groups; documents and term counts."""
    folder = f"{path}/segments/{name}"
    order = ["bucket", "term", "doc_id"]
    laid_out = posts.withColumn("bucket", bucket_of("term", buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
    _write(laid_out, f"{folder}/postings")
    _write(docs, f"{folder}/docs")
    counts = docs.sparkSession.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    _write(counts.repartitionByRange("term").sortWithinPartitions("term"), f"{folder}/terms")


def refresh(docs: DataFrame, path: str, buckets: int = BUCKETS, tokenizer: Tokenizer = X.tokens) -> dict[str, int]:
    """``docs`` (``doc_id``, ``text``, ...) added to the index below ``path`` or replacing what it has of them.

    The first refresh makes the index.  A document without tokens is not indexed, so its
    former version goes.  Of the old index only document rows are read, and the postings of
    replaced documents, to count what their terms lose.  Returns the numbers of documents
    added, replaced and removed, their total and the new version.
    """
    spark = docs.sparkSession
    names, name = segments(spark, path), uuid4().hex
    owner = f"{path}/{name}"
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    counted = staged(count_terms(docs.where("doc_id IS NOT NULL"), tokenizer=tokenizer), owner)
    new_docs = counted.drop("counts")
    _write_segment(path, name, new_docs, postings_of(counted), buckets)
    if names:
        old = _living(spark, path, names, "docs")
        of = F.element_at(F.array(*map(F.lit, names)), F.col("age") + 1)
        dead = staged(old.join(ids, "doc_id", "left_semi").select("doc_id", of.alias("of")), owner)
        posts = _living(spark, path, names, "postings").join(dead.select("doc_id"), "doc_id", "left_semi")
        lost = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        old = new_docs.limit(0)
        dead = new_docs.select("doc_id", F.lit("").alias("of")).limit(0)
        lost = dead.select(F.col("of").alias("term"), F.lit(0).cast("long").alias("df"))
    _write(dead, f"{path}/segments/{name}/dead")
    _write(lost, f"{path}/segments/{name}/lost")
    counts = upsert_stats(old, new_docs, ids).first().asDict()
    version = _publish(spark, path, [*names, name])
    release(spark, owner)
    return counts | {"version": version}


def merge(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """A version with all living rows in one segment; what it replaces stays until ``clean``."""
    docs, posts, _ = read(spark, path)
    name = uuid4().hex
    _write_segment(path, name, docs, posts.drop("bucket"), buckets)
    nothing = docs.select("doc_id", F.lit("").alias("of")).limit(0)
    _write(nothing, f"{path}/segments/{name}/dead")
    _write(nothing.select(F.col("of").alias("term"), F.lit(0).cast("long").alias("df")), f"{path}/segments/{name}/lost")
    return _publish(spark, path, [name])


def clean(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove what the newest ``keep`` whole versions don't name, half-written segments too; returns the segments removed.

    No writer may run meanwhile, and no reader of an older version.
    """
    if keep < 1:
        raise ValueError("the newest version has to stay")
    kept = versions(spark, path)[-keep:]
    named = {n for v in kept for n in segments(spark, path, v)}
    gone = [n for n in _children(spark, f"{path}/segments") if n not in named]
    # versions first: none may name a segment that is gone
    for name in _children(spark, f"{path}/manifests"):
        if name.isdigit() and int(name) not in kept:
            fs, at = _path(spark, f"{path}/manifests/{name}")
            fs.delete(at, True)
    for name in gone:
        fs, at = _path(spark, f"{path}/segments/{name}")
        fs.delete(at, True)
    return gone
