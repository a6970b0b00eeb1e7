"""Tables written once into the folder that driver and executors share, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a folder of the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The rows of `frame`, cut from its lineage: written as Parquet and read back.

    What depends on the partitioning of `frame`, such as generated row numbers, is fixed by the write;
    a lost executor costs no recomputation of what came before.
    """
    folder = new_folder(frame.sparkSession, label)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
