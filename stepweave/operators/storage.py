"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def located(path: str, spark: SparkSession) -> str:
    """A path as Spark's file systems take it: a relative one is below this process's folder where the default file system is local."""
    local = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    return path if "://" in path or path.startswith("file:") or not local else os.path.abspath(path)


def ensure_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a folder of its own; on a cluster, where executors could not
    see such a folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the session's checkpoint folder."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written below the checkpoint folder while a loop runs, and removed after it.

    A checkpoint keeps the sizes that Spark estimated for its plan, which multiply with each join: after many rounds, numbers of
    many thousand digits. A written table has its own size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{ensure_folder(spark).rstrip('/')}/stepweave-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.parquet(path := f"{self.folder}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
