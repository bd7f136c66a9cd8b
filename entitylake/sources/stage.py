"""Intermediate tables that several branches of one job read."""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"

_written: dict[tuple[str, str], list[str]] = {}  # application and owner -> tables not yet removed


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a folder below the warehouse serves, which
    all executors see as well; a folder of the local machine never does.
    """
    named = spark.conf.get(SHARED_FOLDER, None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError(f"set {SHARED_FOLDER} to a folder that driver and executors share")
    return f"{warehouse.rstrip('/')}/.staged"


def fresh_folder(spark: SparkSession, owner: str = "") -> str:
    """A folder of its own in the shared one, removed with the owner's tables."""
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid4().hex}"
    key = (spark.sparkContext.applicationId, owner)
    if key not in _written:
        _written[key] = []
        atexit.register(release, spark, owner)
    _written[key].append(path)
    return path


def staged(df: DataFrame, owner: str = "") -> DataFrame:
    """``df`` computed once, written to the shared folder and read back.

    For a small extract of large texts that is needed more than once: the texts
    are then scanned once, columns are still pruned, and a lost executor costs a
    read, not a new computation.  ``release`` removes an owner's tables when the
    results are written; the end of the program removes all.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, owner)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str = "") -> None:
    """Remove an owner's staged tables; frames that read them are void then."""
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended
        return
    for path in _written.pop((context.applicationId, owner), []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
