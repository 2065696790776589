"""Scans and audit entries kept so that later reads touch only what they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_scan(findings: DataFrame, table: str, by: str = "image", buckets: int = 64) -> DataFrame:
    """Write a scan as a table bucketed and sorted by image, and return it.

    Two scans with one number of buckets are compared (`scan_diff`, `baseline_delta`) without a shuffle. Each task writes one bucket.
    """
    findings.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(table)
    return findings.sparkSession.table(table)


def write_audit(entries: DataFrame, path: str) -> None:
    """Append audit entries to Parquet folders by day (`day=...`), so that a time range reads its days alone."""
    rows = entries.withColumn("day", F.date_from_unix_date(F.floor(F.col("timestamp_unix") / 86400).cast("int")))
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries with their day; `query_audit` and `audit_retention` prune days."""
    return spark.read.parquet(path)
