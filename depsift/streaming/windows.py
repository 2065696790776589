"""Windowed counts over audit entries and releases, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def audit_counts(entries: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "at", action: str = "action", entry: str | None = None) -> DataFrame:
    """Entries of each action in each window: start, action, n.

    With `entry`, the name of an id, an entry delivered more than once counts once. On a stream, entries more than `late` behind the newest are
    dropped, ids are kept as state until the watermark passes their first delivery (so copies must come within `late` of it), and of
    closed windows nothing is kept; on a table all copies are dropped. Rows without a time are left out; a null action is a group.
    """
    rows = entries.withColumn(at, F.col(at).cast("timestamp")).where(F.col(at).isNotNull()).withWatermark(at, late)
    if entry is not None:
        rows = rows.dropDuplicatesWithinWatermark([entry]) if rows.isStreaming else rows.dropDuplicates([entry])
    counts = rows.groupBy(F.window(at, width).alias("w"), F.col(action).alias("action")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "action", "n")


def write_closed_windows(counts: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append the counts of closed windows to Parquet files in `path`: each window once, after the watermark has passed its end."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def release_bursts(releases: DataFrame, least: int = 3, width: str = "24 hours", step: str = "1 hour", late: str = "1 hour",
                   at: str = "at", package: str = "package") -> DataFrame:
    """Sliding windows in which a package had at least `least` releases: start, package, n."""
    rows = releases.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counts = rows.groupBy(F.window(at, width, step).alias("w"), F.col(package).alias("package")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "package", "n")
