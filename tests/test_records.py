"""Records of a small file are made by many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import derived, retrieval


def test_records_of_one_small_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    rows = [(i if i % 40 else None, f"tin {i % 7}", "Brand", "A B", i % 30, float(i)) for i in range(200)]
    kinds = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    parts = spark.createDataFrame(rows + rows[:5], kinds).select(*names)
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))

    def postings():
        return sorted(map(tuple, retrieval.field_postings(spark, str(tmp_path)).collect()))

    whole = postings()
    monkeypatch.setattr(derived, "RECORD_ROWS", 20)
    found = derived.records(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(found) == 10 and max(r["count"] for r in found) <= 30
    assert postings() == whole
