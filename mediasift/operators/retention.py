"""Retention as a planning query: what to delete, keep, quarantine or report (K01-K03, E05-E06,
E08, F01, F02). The plan is a table; carrying it out belongs to the storage operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.operators import ordered
from mediasift.params import Params


def ttl_minutes(location: Column, params: Params) -> Column:
    return F.when(location == "quarantine", params.quarantine_ttl_hours * 60).otherwise(
        params.workspace_ttl_minutes
    )


def is_expired(mtime: Column, as_of: Column, minutes: Column) -> Column:
    """Age has reached the limit, inclusively; null when the age is unknown."""
    age = F.timestamp_diff("MICROSECOND", mtime, as_of)
    return age >= minutes.cast("bigint") * 60_000_000


def retention_plan(
    entries: DataFrame, active_tasks: DataFrame, as_of: Column, params: Params | None = None
) -> DataFrame:
    """Adds action ('delete', 'keep', 'report') and issue_code to workspace entries.

    entries: analysis_id, location, mtime, is_symlink, is_dir. Untrusted entries are reported
    without an id. Only inactive tasks may lose their workspace (E05).
    """
    params = params or Params()
    place = F.col("location")
    trusted = X.is_system_id(F.col("analysis_id")) & ~F.col("is_symlink") & F.col("is_dir")
    expired = is_expired(F.col("mtime"), as_of, ttl_minutes(place, params))
    busy = active_tasks.select("analysis_id").distinct().withColumn("is_active", F.lit(True))
    joined = entries.join(busy, "analysis_id", "left")
    return joined.withColumns(
        {
            "action": F.when(~trusted | expired.isNull(), "report")
            .when(expired & F.col("is_active").isNull(), "delete")
            .otherwise("keep"),
            "issue_code": F.when(~trusted, F.concat(place, F.lit("_entry_unsafe"))).when(
                expired.isNull(), F.concat(place, F.lit("_age_unavailable"))
            ),
            "reported_id": F.when(trusted, F.col("analysis_id")),
        }
    ).drop("is_active")


def sweep_counts(plan: DataFrame) -> DataFrame:
    """Entries per location, action and issue (F02, the counting half); untrusted names are not shown."""
    return plan.groupBy("location", "action", "issue_code").agg(
        F.count("*").alias("n_entries"),
        F.min("reported_id").alias("first_id"),
        F.max("reported_id").alias("last_id"),
    )


def sweep_listing(plan: DataFrame) -> DataFrame:
    """The ordered id lists of a sweep in long form: one row per id with its position.

    A list per action would gather one action's ids in one task; positions come from pieces by the first two,
    four and six characters of the ids. Untrusted entries have no id to list;
    `sweep_counts` has their number.
    """
    return ordered.with_position(
        plan.where("action <> 'keep' AND reported_id IS NOT NULL").select("location", "action", "analysis_id"),
        ["location", "action"],
        ["analysis_id"],
        [F.substring("analysis_id", 1, n) for n in (2, 4, 6)],
        "position",
    )


def recovery_decision(attempts: DataFrame, params: Params | None = None) -> DataFrame:
    """After delete attempts (analysis_id, ok): deleted, retry, quarantined or failed."""
    params = params or Params()
    exhausted = F.col("n_attempts") >= 1 + params.cleanup_retries
    last_resort = "quarantined" if params.quarantine_enabled else "failed"
    return (
        attempts.groupBy("analysis_id")
        .agg(F.count("*").alias("n_attempts"), F.bool_or("ok").alias("deleted"))
        .withColumn(
            "decision",
            F.when(F.col("deleted"), "deleted").when(exhausted, last_resort).otherwise("retry"),
        )
    )


def cleanup_status(original: Column, intermediate: Column) -> Column:
    return (
        F.when(original & intermediate, "completed")
        .when(original | intermediate, "partial")
        .otherwise("failed")
    )


def cleanup_rollup(obligations: DataFrame) -> DataFrame:
    """Cleanup outcome per analysis from (analysis_id, kind, deleted) rows.

    kind is 'original' or 'intermediate'. Without intermediate files none are left over.
    """
    def all_deleted(kind: str) -> Column:
        return F.coalesce(
            F.bool_and(F.when(F.col("kind") == kind, F.col("deleted"))), F.lit(kind == "intermediate")
        )

    done = obligations.groupBy("analysis_id").agg(
        all_deleted("original").alias("original_file_deleted"),
        all_deleted("intermediate").alias("intermediate_files_deleted"),
    )
    return done.withColumn(
        "status",
        cleanup_status(F.col("original_file_deleted"), F.col("intermediate_files_deleted")),
    )


def outstanding(registered: DataFrame, completed: DataFrame) -> DataFrame:
    """Registered artifacts that are not yet cleaned up."""
    key = ["analysis_id", "artifact_id"]
    return registered.join(completed.select(*key), key, "left_anti")
