"""Files arriving over time: the gate as a stream.

`gate_arrivals` judges files against probe documents that are there already. Where probes come when they
come, `complete_arrivals` joins three streams: what was received, the bytes that were read, and the probes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas
from mediasift.operators import gate
from mediasift.params import Params
from mediasift.functions import probe as P
from mediasift.plans.intake import attach_probes, without_reads
from mediasift.sources import media
from mediasift.sources.results import latest_per_id


def read_arrivals(
    spark: SparkSession, path: str, params: Params, *, files_per_trigger: int = 1000
) -> DataFrame:
    """New files as a stream; the trigger size is the back-pressure.

    Files over the hard limit come without content, which is never read, and are judged by their size.
    """
    listed = (
        spark.readStream.format("binaryFile")
        .schema(schemas.BINARY_FILE)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    over = F.col("length") > params.hard_limit_bytes
    unread = listed.where(over).withColumn("content", F.lit(None).cast("binary"))
    return listed.where(~over).unionByName(unread)


def gate_arrivals(
    arrivals: DataFrame,
    probes: DataFrame,
    *,
    source: Column,
    as_of: Column,
    params: Params | None = None,
) -> DataFrame:
    """Verdicts of arriving files. Probe documents are a static table read per trigger."""
    params = params or Params()
    registered = media.register(arrivals, source, as_of)
    return gate.run_gate(attach_probes(media.measure(registered, params), probes), params)


def complete_arrivals(
    manifest: DataFrame, files: DataFrame, probes: DataFrame, *, within_minutes: int = 120, delay: str = "1 hour"
) -> DataFrame:
    """Every received file with its measured bytes and its probe document, whichever of them comes first.

    `manifest` (analysis_id, received_at, length, ...) has a row for each file received, listed or not;
    `files` (analysis_id, file_at, and what `measure` found) and `probes` (analysis_id, probed_at,
    probe_status, probe_json) may come before or after it. A part counts if its time is `within_minutes`
    of the receipt. A row goes out as soon as its parts are there, or without the missing ones once the
    watermark, `delay` behind the newest row of each stream, has passed the time in which they could come.
    State holds that stretch of time and no more, and no bytes of files. Rows without an id are in no join;
    Spark drops them before it looks at their time.
    """
    near = lambda t: (
        F.expr(f"{t} >= received_at - INTERVAL {within_minutes} MINUTES AND {t} <= received_at + INTERVAL {within_minutes} MINUTES")
    )
    received = manifest.withWatermark("received_at", delay)
    read = files.withColumnRenamed("analysis_id", "file_id").withWatermark("file_at", delay)
    probed = probes.withColumnRenamed("analysis_id", "probe_id").withWatermark("probed_at", delay)
    # a stream has one event time; that of the receipt goes on, the other becomes a plain column
    plain = lambda frame, t: frame.withColumn(t, F.timestamp_micros(F.unix_micros(t)))
    both = received.join(read, (F.col("file_id") == F.col("analysis_id")) & near("file_at"), "leftOuter")
    all_ = plain(both, "file_at").join(probed, (F.col("probe_id") == F.col("analysis_id")) & near("probed_at"), "leftOuter")
    return plain(all_, "probed_at")


def gate_complete(joined: DataFrame, params: Params | None = None) -> DataFrame:
    """Verdicts of `complete_arrivals`.

    A file whose bytes never came has the size of its receipt: an empty one is rejected, another fails on
    our side. So does one that needs a probe and got none in time.
    """
    known = joined.withColumns(
        {
            "size_bytes": F.coalesce("size_bytes", "length"),
            "sha256": F.when(F.col("length") == 0, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha256")),
            "probe": P.flatten(F.col("probe_json")),
        }
    )
    return gate.run_gate(known if "read_status" in joined.columns else without_reads(known), params or Params())


def latest_outcomes(outcomes: DataFrame, received: DataFrame) -> DataFrame:
    """One row for each row of `received` (analysis_id), as tables: its last outcome, or status `waiting`.

    A file that was probed or read more than once has the outcome of the newest probe, then the newest read.
    """
    known = latest_per_id(outcomes, "analysis_id", "probed_at", "file_at")
    rows = received.select("analysis_id").join(known, "analysis_id", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("waiting")))


def write_latest(
    outcomes: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None
):
    """Append each micro-batch once: a batch directory is replaced when the batch is replayed."""

    def default(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_id(batch, "analysis_id", "modificationTime", "path")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        outcomes.writeStream.foreachBatch(write or default)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
