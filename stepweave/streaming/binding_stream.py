"""Binding of steps as their feature files change: a file stream joined with a fixed set of definitions. An extension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binding import binding_edges
from ..sources.gherkin import parse_feature


def feature_steps(files: DataFrame) -> DataFrame:
    """(path, scenario, ordinal, text) of feature files (path, text); works on streams and tables alike."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sc in (parse_feature(text) or {"scenarios": []})["scenarios"]:
                    rows += [(path, sc["name"], s["ordinal"], s["text"]) for s in sc["steps"]]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "scenario", "ordinal", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, scenario string, ordinal int, text string")


def watch(spark: SparkSession, folder: str, definitions: DataFrame, out: str, checkpoint: str):
    """A query that appends the binding of every step of new or changed feature files to a Parquet folder.

    definitions: (id, pattern). Each micro-batch is bound as a table is, so the join stays the split one.
    """
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.feature").option("recursiveFileLookup", "true").load(folder)
    steps = feature_steps(stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))

    def bind(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("id", F.xxhash64("path", "scenario", "ordinal"))
        edges = binding_edges(keyed.select("id", "text"), definitions)
        got = keyed.join(edges, F.col("id") == F.col("step_id")).select("path", "scenario", "ordinal", "text", "step_definition_id", "confidence")
        got.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return steps.writeStream.foreachBatch(bind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
