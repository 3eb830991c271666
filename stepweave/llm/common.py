"""What the corpus operators share: table access, the word rule, shared scratch space."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as array<string>; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def normal_line(line: Column) -> Column:
    """Lower case, white space as single blanks, then none at the ends. The pattern, which is slow, runs only where there is something to do."""
    line = F.lower(line)
    odd = F.contains(line, F.lit("  "))
    for c in "\t\n\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE_CLASS + "+", " ")).otherwise(line))


def without(df: DataFrame, made: list[str]) -> DataFrame:
    """df less the columns that an operator is going to make: of clashing names, the operator's column stays."""
    return df.drop(*[c for c in df.columns if c in made])


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the session says. A local session that says nothing gets a folder of its own; on a cluster, where
    executors could not see such a folder, that is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage; survives lost executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tasks of the smallest frames that few() deals.
LEAST_PARTS = 8


def few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df in a partition for each `each` rows, where it has more: a few thousand rows aren't worth a task for each shuffle partition."""
    return df.coalesce(max(LEAST_PARTS, -(-rows // each)))


#: Rows of two numbers (32 MB at most) that are broadcast to find their texts or lines; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df, materialised, and broadcast if it has at most BROADCAST_ROWS rows. For rows of two numbers."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle and checkpoint files of frames that nothing refers to any more.

    The cleaner learns of them when the driver's garbage is collected, which a long loop of small jobs seldom causes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder, which the driver and all executors share."""
    ensure_checkpoints(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/stepweave-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of written rows that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
