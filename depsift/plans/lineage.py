"""Cutting lineage so that iterative jobs survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`. Without one, a session on one machine (`local`, as in tests) gets a temporary folder
    and a cluster is refused: its machines share no such folder, and a lost one would take checkpoints with it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="depsift-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint of `df` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it lies."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
