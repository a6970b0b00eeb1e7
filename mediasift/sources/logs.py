"""Technical log events as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions import text as X


def log_line(events: DataFrame, ts: Column) -> DataFrame:
    """One JSON line per event: the eight listed fields, nulls left out, millisecond UTC."""
    event = F.col("event") if "event" in events.columns else F.lit(None).cast("string")
    written = {"timestamp": X.iso_utc_millis(ts), "event": F.coalesce(event, F.lit("log"))}
    present = [f for f in vocab.LOG_FIELDS if f in written or f in events.columns]
    record = F.struct(*[written.get(f, F.col(f)).alias(f) for f in present])
    return events.select(F.to_json(record, {"ignoreNullFields": "true"}).alias("value"))


def write_log(events: DataFrame, ts: Column, path: str) -> None:
    log_line(events, ts).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG_EVENT).json(path)
