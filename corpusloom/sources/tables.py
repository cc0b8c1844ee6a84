"""Tables between steps, in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without the setting gets a folder of its own; elsewhere it is required."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    path = sc._jvm.org.apache.hadoop.fs.Path(found.rstrip("/"))
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
