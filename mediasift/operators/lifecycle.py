"""Task histories: legality, stamps, latest state, routing and backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.operators import ordered
from mediasift.params import Params
from mediasift.sources import dims

NONE = "none"


def with_previous_state(events: DataFrame, chunk: Column | None = None, order: str = "seq") -> DataFrame:
    """prev_status and prev_stage of each event; `none` for the first event of a task.

    Without a `chunk` that bounds the rows of a task, tasks are cut wherever a partition ends.
    """
    values = ["status", "stage"]
    if chunk is None:
        out = ordered.with_previous_ranged(events, "analysis_id", order, values)
    else:
        out = ordered.with_previous(events, "analysis_id", order, chunk, values)
    return out.withColumns(
        {
            "prev_status": F.coalesce("prev_status", F.lit(NONE)),
            "prev_stage": F.coalesce("prev_stage", F.lit(NONE)),
        }
    )


def illegal_transitions(events: DataFrame, chunk: Column | None = None, order: str = "seq") -> DataFrame:
    """Events whose step is not in the transition table.

    A history must begin in the initial state, which is one more allowed step.
    """
    spark = events.sparkSession
    start = spark.createDataFrame(
        [(NONE, NONE, *vocab.INITIAL_STATE)],
        "prev_status string, prev_stage string, status string, stage string",
    )
    # nine rows, fixed
    allowed = F.broadcast(dims.allowed_transitions(spark).unionByName(start))
    return with_previous_state(events, chunk, order).join(
        allowed, ["prev_status", "prev_stage", "status", "stage"], "left_anti"
    )


def stamp_report(events: DataFrame) -> DataFrame:
    """Per task: are start and finish set once, exactly at their stage (G04), and cleanup
    recorded at most once, in its stage (G10)?

    Needs status, stage, started_at, finished_at, cleanup_recorded per event. Counts combine
    before the shuffle.
    """
    begins = F.col("stage") == "preprocessing"
    ends = F.col("stage") == "finished"
    records = F.coalesce(F.col("cleanup_recorded"), F.lit(False))
    counts = events.groupBy("analysis_id").agg(
        F.count_if(begins & F.col("started_at").isNotNull()).alias("starts"),
        F.count_if(begins & F.col("started_at").isNull()).alias("unstamped_starts"),
        F.count_if(~begins & F.col("started_at").isNotNull()).alias("stray_starts"),
        F.count_if(ends & F.col("finished_at").isNotNull()).alias("finishes"),
        F.count_if(ends & F.col("finished_at").isNull()).alias("unstamped_finishes"),
        F.count_if(~ends & F.col("finished_at").isNotNull()).alias("stray_finishes"),
        F.count_if(records).alias("cleanup_records"),
        F.count_if(records & (F.col("stage") != "cleanup")).alias("stray_cleanup_records"),
    )
    return counts.withColumns(
        {
            "start_ok": (F.col("starts") <= 1)
            & (F.col("unstamped_starts") == 0)
            & (F.col("stray_starts") == 0),
            "finish_ok": (F.col("finishes") <= 1)
            & (F.col("unstamped_finishes") == 0)
            & (F.col("stray_finishes") == 0),
            "cleanup_ok": (F.col("cleanup_records") <= 1) & (F.col("stray_cleanup_records") == 0),
        }
    )


def finish_time(finished_at: Column, as_of: Column) -> Column:
    """Recorded end of cleanup, or the run's time when the record has none."""
    return F.coalesce(finished_at, as_of)


def latest_state(events: DataFrame, order: str = "seq") -> DataFrame:
    """Newest event per task."""
    rest = [c for c in events.columns if c != "analysis_id"]
    return (
        events.groupBy("analysis_id")
        .agg(F.max_by(F.struct(*rest), order).alias("s"))
        .select("analysis_id", *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def duplicate_ids(rows: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def admit(incoming: DataFrame, known: DataFrame, order: str, key: str = "analysis_id") -> DataFrame:
    """First row of each new id; ids already known are refused.

    Refusal comes before the choice, so known ids are not aggregated at all.
    """
    fresh = incoming.join(known.select(key), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    return (
        fresh.groupBy(key)
        .agg(F.min_by(F.struct(*rest), order).alias("r"))
        .select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def bind_routes(tasks: DataFrame, bindings: DataFrame) -> DataFrame:
    """Route of each task by its media type; null where nothing is bound."""
    return tasks.join(dims.broadcast_if_small(bindings), "media_type", "left")


def unbound(tasks: DataFrame, bindings: DataFrame) -> DataFrame:
    """Tasks without a route: an infrastructure failure, not a rejection."""
    return tasks.join(dims.broadcast_if_small(bindings), "media_type", "left_anti")


def route_violations(tasks: DataFrame) -> DataFrame:
    """Route equals the media type; the queue time exists once queued and not before."""
    early = F.col("stage").isin("registered", "validation", "routing")
    return tasks.where(
        (F.col("route").isNotNull() & (F.col("route") != F.col("media_type")))
        | (early & F.col("queued_at").isNotNull())
        | (~early & F.col("queued_at").isNull())
    )


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("stage") != "finished")


def pending_by_media(tasks: DataFrame) -> DataFrame:
    """Waiting tasks per media type."""
    return (
        tasks.where((F.col("status") == "queued") & (F.col("stage") == "queued"))
        .groupBy("media_type")
        .agg(F.count("*").alias("n_pending"))
    )


def backlog(tasks: DataFrame, params: Params | None = None) -> DataFrame:
    """FIFO position of every waiting task in its media type, and whether it fits.

    There are only three media types, so positions come from pieces of days, minutes and, within a minute,
    instants and beginnings of ids, not from a window per type.
    """
    params = params or Params()
    waiting = tasks.where((F.col("status") == "queued") & (F.col("stage") == "queued")).select(
        "media_type", "queued_at", "analysis_id"
    )
    capacity = F.create_map(
        *[x for m in vocab.MEDIA_TYPES for x in (F.lit(m), F.lit(params.capacity(m)))]
    )
    pieces = [
        F.date_trunc("day", "queued_at"),
        F.date_trunc("minute", "queued_at"),
        F.struct("queued_at", F.substring("analysis_id", 1, 2)),
    ]
    return ordered.with_position(
        waiting, ["media_type"], ["queued_at", "analysis_id"], pieces, "fifo_position"
    ).withColumn(
        "within_capacity",
        F.col("fifo_position") <= F.try_element_at(capacity, F.col("media_type")),
    )


def safe_errors(errors: Column) -> Column:
    """The four fields of an error that a snapshot shows."""
    return F.transform(
        errors,
        lambda e: F.struct(
            e["code"].alias("code"),
            e["category"].alias("category"),
            e["message"].alias("message"),
            e["retryable"].alias("retryable"),
        ),
    )


def snapshots(tasks: DataFrame) -> DataFrame:
    """Read-only task view without workspace paths."""
    cleanup = F.col("cleanup")
    return tasks.select(
        "analysis_id",
        "created_at",
        "status",
        "stage",
        "source",
        "media_type",
        "config_snapshot_id",
        "queued_at",
        "started_at",
        "finished_at",
        "route",
        F.when(cleanup.isNotNull(), cleanup.withField("errors", safe_errors(cleanup["errors"]))).alias(
            "cleanup"
        ),
        safe_errors(F.col("errors")).alias("errors"),
    )
