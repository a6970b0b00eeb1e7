"""Running a stream over what is available now, with results and progress in shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mediasift.operators.ordered import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the session's checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stream_table(
    spark: SparkSession, sf_dir: str, table: str, *, files_per_trigger: int = 100
) -> DataFrame:
    """A stored table as a stream, with its schema: a folder of part files, or one file.

    A stream source takes a folder only, so that a single file is picked from its parent by name.
    """
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process all available input, wait, and return the written rows as a table."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
