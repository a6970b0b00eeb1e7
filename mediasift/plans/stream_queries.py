"""Streams over the test tables, run with everything available and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.operators import gate
from mediasift.plans.file_queries import GATE_SQL, gate_inputs
from mediasift.plans.registry import PARAMS, query
from mediasift.plans.views import cte, derive, read
from mediasift.streaming import intake, lifecycle
from mediasift.streaming.run import run_available, stream_table


@query("stream_gate", f"{GATE_SQL} SELECT doc_id, status, error_code FROM o")
def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    files = derive(stream_table(spark, sf, "documents"), "files_v")
    return run_available(
        gate.run_gate(gate_inputs(files), PARAMS).select("doc_id", "status", "error_code")
    )


_STEPS = (
    "(SELECT * FROM (VALUES ('none', 'none', 'queued', 'registered'), "
    + ", ".join(str(t) for t in vocab.ALLOWED_TRANSITIONS)
    + ") AS t(a, b, c, d))"
)


def _histories(spark: SparkSession, sf: str) -> DataFrame:
    return derive(stream_table(spark, sf, "events"), "state_v").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_state",
    f"{cte('state_v')}, h AS (SELECT analysis_id, seq, status, stage, "
    "coalesce(lag(status) OVER w, 'none') AS prev_status, coalesce(lag(stage) OVER w, 'none') AS prev_stage "
    "FROM state_v WINDOW w AS (PARTITION BY analysis_id ORDER BY seq)) "
    f"SELECT *, (prev_status, prev_stage, status, stage) IN {_STEPS} AS legal, false AS late FROM h",
)
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.run_transitions(_histories(spark, sf)).drop("expired")


_TTL_MINUTES, _DELAY_MINUTES = 2880, 1440


@query(
    "stream_expiry",
    f"{cte('state_v')}, h AS (SELECT analysis_id, seq, status, stage, ts, "
    "lag(status) OVER w AS before_status, lag(stage) OVER w AS before_stage, "
    f"ts - lag(ts) OVER w > INTERVAL {_TTL_MINUTES} MINUTE AS forgotten, lead(ts) OVER w - ts > INTERVAL {_TTL_MINUTES} MINUTE AS silent, "
    "lead(ts) OVER w AS next_ts FROM state_v WINDOW w AS (PARTITION BY analysis_id ORDER BY seq)), "
    "j AS (SELECT *, CASE WHEN before_status IS NULL OR forgotten THEN 'none' ELSE before_status END AS prev_status, "
    "CASE WHEN before_status IS NULL OR forgotten THEN 'none' ELSE before_stage END AS prev_stage FROM h) "
    f"SELECT analysis_id, seq, (prev_status, prev_stage, status, stage) IN {_STEPS} AS legal, "
    f"CASE WHEN next_ts IS NULL THEN epoch_ms(ts) + {_TTL_MINUTES * 60_000} + 1 <= "
    f"(SELECT max(epoch_ms(ts)) FROM state_v) - {_DELAY_MINUTES * 60_000} ELSE silent END AS expired FROM j",
)
def stream_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks silent for two days are forgotten: by a timer, or when their next event shows the silence."""
    out = lifecycle.run_transitions(_histories(spark, sf), delay=f"{_DELAY_MINUTES} minutes", ttl_minutes=_TTL_MINUTES)
    return out.select("analysis_id", "seq", "legal", "expired")


_WITHIN = 120
_RECEIVED = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * doc_id"
# bytes of some files never come, and some probes come before the file, or too late
_CAME = "(doc_id % 17 <> 3 AND size_bytes > 0)"
_FILE_AFTER, _PROBE_AFTER = "((doc_id * 7) % 30)", "((doc_id * 13) % 180 - 20)"
_ARRIVED = (
    f"arrived_v AS (SELECT * REPLACE (CASE WHEN probe_status IS NULL OR {_PROBE_AFTER} <= {_WITHIN} THEN probe_status ELSE 'system_failure' END AS probe_status, "
    f"CASE WHEN {_CAME} THEN header_kind END AS header_kind, CASE WHEN {_CAME} THEN read_status END AS read_status) FROM files_v), p AS ("
)


@query(
    "stream_late_probes",
    GATE_SQL.replace("p AS (", _ARRIVED, 1)
    .replace("FROM files_v),\nd AS", "FROM arrived_v),\nd AS", 1)
    .replace("doc_id % 37 = 0 AS broken", f"CASE WHEN {_CAME} THEN doc_id % 37 = 0 ELSE size_bytes > 0 END AS broken", 1)
    + " SELECT doc_id, status, error_code FROM o",
)
def stream_late_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts, bytes and probes as three streams, each with a last row that closes its time."""

    def arriving(frame: DataFrame, time: str) -> DataFrame:
        regions = stream_table(spark, sf, "region").where("r_regionkey = 0")
        ends = regions.select(F.lit("end").alias("analysis_id"), F.expr("TIMESTAMP '2099-01-01 00:00:00'").alias(time))
        return frame.unionByName(ends, allowMissingColumns=True)

    def files() -> DataFrame:
        return derive(stream_table(spark, sf, "documents"), "files_v").withColumn("received_at", F.expr(_RECEIVED))

    after = lambda minutes: F.expr(f"received_at + INTERVAL '1' MINUTE * {minutes}")
    inputs = gate_inputs(files(), "received_at")
    manifest = inputs.select("doc_id", "analysis_id", "original_name", "declared_content_type", F.col("size_bytes").alias("length"), "received_at")
    came = gate_inputs(files().where(_CAME), "received_at").select(
        "analysis_id", "size_bytes", "sha256", "header_kind", "document_type", "brands", "read_status", "image", after(_FILE_AFTER).alias("file_at")
    )
    probes = files().where("probe_status IS NOT NULL").select("analysis_id", "probe_status", "probe_json", after(_PROBE_AFTER).alias("probed_at"))
    joined = intake.complete_arrivals(
        arriving(manifest, "received_at"), arriving(came, "file_at"), arriving(probes, "probed_at"), within_minutes=_WITHIN
    )
    judged = intake.gate_complete(joined, PARAMS).select("analysis_id", "doc_id", "status", "error_code", "probed_at", "file_at")
    received = derive(read(spark, sf, "documents"), "files_v").select("analysis_id")
    return intake.latest_outcomes(run_available(judged), received).select("doc_id", "status", "error_code")


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS analysis_id FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    lifecycle.use_rocksdb(spark)
    events = stream_table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("analysis_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    return run_available(lifecycle.first_arrivals(events, delay="60 days").select("analysis_id"))
