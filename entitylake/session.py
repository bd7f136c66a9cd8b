"""Session settings the jobs rely on; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The operators build large expressions; recording the call site of each part
    # would double the time to build them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "entitylake", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the required settings.

    The number of shuffle partitions is not fixed here: a cluster sets it for its
    data size and adaptive execution merges small ones.  Extra settings are passed
    as ``{"spark.some.key": "value"}``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
