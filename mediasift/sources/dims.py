"""Fixed dimensions as DataFrames, and a size check for anything that is to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.params import Params

BROADCAST_ROWS = 100_000


def format_matrix(spark: SparkSession) -> DataFrame:
    """12 rows: extension, detected_mime, media_type, container (A10)."""
    return spark.createDataFrame(
        list(vocab.FORMATS),
        "extension string, detected_mime string, media_type string, container string",
    )


def size_limits(spark: SparkSession, params: Params) -> DataFrame:
    rows = [(m, params.limit_bytes(m)) for m in vocab.MEDIA_TYPES]
    return spark.createDataFrame(rows, "media_type string, limit_bytes bigint")


def allowed_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(vocab.ALLOWED_TRANSITIONS),
        "prev_status string, prev_stage string, status string, stage string",
    )


def recommendation_policy(spark: SparkSession) -> DataFrame:
    """Provisional action per (completeness, level): our values, versioned by the parameters."""
    rows = [
        ("complete", "low", "no_additional_action", False),
        ("complete", "medium", "manual_review", True),
        ("complete", "high", "escalate_to_security", True),
        ("partial", "low", "verify_source", False),
        ("partial", "medium", "manual_review", True),
        ("partial", "high", "escalate_to_security", True),
        ("insufficient", "none", "request_better_quality_source", True),
        ("not_assessed", "none", "retry_analysis", True),
    ]
    return spark.createDataFrame(
        rows,
        "completeness_status string, level_key string, primary_action string, "
        "requires_manual_review boolean",
    )


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most `max_rows + 1` rows.

    A larger table gets no hint: the planner then shuffles both sides, and adaptive execution
    splits skewed partitions.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
