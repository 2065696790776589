"""Projects to scan again because their build or dependency files changed, from a watched folder, a stream or a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depsift.operators.containers import is_dependency_file

FILES = "path string, modificationTime timestamp, length long, content binary"
SUMMARY = "project string, files long, changed timestamp, critical long, high long, batch long"


def watched_files(spark: SparkSession, folder: str, per_batch: int = 10_000) -> DataFrame:
    """A stream of the files that come into `folder`/<project>/...: project, path, at (time of modification).

    The file source tells each file once. Names and times are read from the listing, contents are not kept.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inside = F.regexp_replace("path", "^(?:[a-z]+:)?(?://[^/]*)?\\Q" + root + "/\\E", "")
    return files.select(F.substring_index(inside, "/", 1).alias("project"), inside.alias("path"), F.col("modificationTime").alias("at"))


def changed_projects(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per project with changed dependency files: project, files, changed (last time), critical, high (findings now).

    changes: project, path, at; findings: project, severity. Only the findings of changed projects are counted.
    """
    rows = changes.where(is_dependency_file(F.col("path"))).groupBy(F.col("project").cast("string").alias("project"))
    rows = rows.agg(F.count("*").alias("files"), F.max("at").cast("timestamp").alias("changed"))
    named = findings.select(F.col("project").cast("string").alias("project"), F.upper("severity").alias("severity")).where("severity in ('CRITICAL', 'HIGH')")
    counts = named.join(rows.select("project"), "project", "left_semi").groupBy("project").agg(*[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high")])
    return rows.join(counts, "project", "left").fillna(0, ["critical", "high"])


def rescan_batches(
    changes: DataFrame, findings: Callable[[], DataFrame], out: str, checkpoint: str, once: bool = True, every: str = "1 minute",
) -> StreamingQuery:
    """Summarise the projects of each micro-batch of `changes` into the folder `out`/batch=<id>; returns the running query.

    `findings` gives the table of findings as it is now. A batch that is run again, because the job was lost before its end was
    noted, overwrites its own folder, so that replays change nothing. `once` reads what there is and stops.
    """

    def summarise(batch: DataFrame, number: int) -> None:
        changed_projects(batch, findings()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = changes.writeStream.foreachBatch(summarise).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def rescan_summaries(spark: SparkSession, out: str) -> DataFrame:
    """The last summary of each project from the folders of `rescan_batches`."""
    rows = spark.read.schema(SUMMARY).parquet(out)
    last = rows.groupBy("project").agg(F.max(F.struct("batch", "files", "changed", "critical", "high")).alias("l"))
    return last.select("project", "l.*")


def rescan_alerts(changes: DataFrame, findings: DataFrame, width: str = "1 hour", late: str = "1 hour", by: str = "project") -> DataFrame:
    """Projects whose build or dependency files changed in a window, with their critical and high findings: start, by, critical, high.

    changes: by, path, at, a stream or a table; findings: by, severity, a table that is read anew in each batch of a
    stream. A project alerts once a window, with zeros if it has no findings.
    """
    rows = changes.where(is_dependency_file(F.col("path"))).withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), by).agg(F.count("*").alias("files"))
    counts = findings.groupBy(by).agg(*[F.count_if(F.upper("severity") == s.upper()).alias(s) for s in ("critical", "high")])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(counts, by, "left").select(F.col("w.start").alias("start"), by, "files", zero("critical"), zero("high"))
