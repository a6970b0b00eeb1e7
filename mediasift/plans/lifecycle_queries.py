"""Queries over task histories, backlog, retention and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.operators import gate, histories, lifecycle, reconcile, retention
from mediasift.operators import rules as R
from mediasift.plans.registry import PARAMS, event_chunk, query
from mediasift.plans.views import cte, read, view
from mediasift.sources import logs

_ALLOWED = (
    "(VALUES ('none', 'none', 'queued', 'registered'), "
    + ", ".join(str(t) for t in vocab.ALLOWED_TRANSITIONS)
    + ") AS t(prev_status, prev_stage, status, stage)"
)


_STEP = ("analysis_id", "seq", "status", "stage", "prev_status", "prev_stage")


@query(
    "transitions_illegal",
    f"{cte('state_v')}, h AS (SELECT analysis_id, seq, status, stage, "
    "coalesce(lag(status) OVER w, 'none') AS prev_status, coalesce(lag(stage) OVER w, 'none') AS prev_stage "
    "FROM state_v WINDOW w AS (PARTITION BY analysis_id ORDER BY seq)) "
    f"SELECT * FROM h WHERE (prev_status, prev_stage, status, stage) NOT IN (SELECT * FROM {_ALLOWED})",
)
def transitions_illegal(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_v").select("analysis_id", "seq", "status", "stage")
    return lifecycle.illegal_transitions(events, event_chunk()).select(*_STEP)


@query(
    "transitions_task",
    f"{cte('task_step_v')}, h AS (SELECT analysis_id, seq, status, stage, "
    "coalesce(lag(status) OVER w, 'none') AS prev_status, coalesce(lag(stage) OVER w, 'none') AS prev_stage "
    "FROM (SELECT DISTINCT analysis_id, seq, status, stage FROM task_step_v) WINDOW w AS (PARTITION BY analysis_id ORDER BY seq)) "
    "SELECT prev_status, prev_stage, status, stage, count(*) AS n_steps FROM h "
    f"WHERE (prev_status, prev_stage, status, stage) NOT IN (SELECT * FROM {_ALLOWED}) GROUP BY ALL",
)
def transitions_task(spark: SparkSession, sf: str) -> DataFrame:
    steps = view(spark, sf, "task_step_v").select("analysis_id", "seq", "status", "stage").distinct()
    return (
        lifecycle.illegal_transitions(steps)
        .groupBy("prev_status", "prev_stage", "status", "stage")
        .agg(F.count("*").alias("n_steps"))
    )


_OPS = "(SELECT DISTINCT analysis_id, seq, op, status, stage, started, finished, route, media_type FROM task_op_v)"
#: Runs the machine over every task at once, one event of each task a round.
_RUN = f"""{cte('task_op_v')}, e AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY seq) AS n FROM {_OPS}),
r AS (
  SELECT e.analysis_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS op, 'none' AS at_status, 'none' AS at_stage,
    false AS bound, false AS queued, NULL::BOOLEAN AS accepted FROM (SELECT DISTINCT analysis_id FROM e) e
  UNION ALL
  SELECT analysis_id, n, seq, op, CASE WHEN ok AND op = 'transition' THEN status ELSE at_status END,
    CASE WHEN ok AND op = 'transition' THEN stage ELSE at_stage END, bound OR (ok AND op = 'bind_route'), queued OR (ok AND op = 'enqueue'), ok
  FROM (
    SELECT e.analysis_id, e.n, e.seq, e.op, e.status, e.stage, r.at_status, r.at_stage, r.bound, r.queued,
      CASE e.op
        WHEN 'transition' THEN (r.at_status, r.at_stage, e.status, e.stage) IN (SELECT * FROM {_ALLOWED})
          AND (e.started = (e.stage = 'preprocessing')) AND (e.finished = (e.stage = 'finished')) AND (e.stage <> 'preprocessing' OR r.queued)
        WHEN 'bind_route' THEN r.at_stage = 'routing' AND NOT r.bound AND e.route = e.media_type
        WHEN 'enqueue' THEN r.at_stage = 'queued' AND NOT r.queued
        ELSE false END AS ok
    FROM r JOIN e ON e.analysis_id = r.analysis_id AND e.n = r.n + 1))"""


def _judged_ops(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    events = view(spark, sf, "task_op_v").select(
        "analysis_id", "seq", "op", "status", "stage", "started", "finished", "route", "media_type"
    )
    symbol = histories.symbol_of(
        c("op"),
        c("status"),
        c("stage"),
        started=F.when(c("started"), c("seq")),
        finished=F.when(c("finished"), c("seq")),
        route=c("route"),
        media_type=c("media_type"),
    )
    return histories.judged(events.distinct().withColumn("symbol", symbol).select("analysis_id", "seq", "op", "status", "stage", "symbol"))


@query("history_accepted", f"WITH RECURSIVE {_RUN[5:]} SELECT analysis_id, seq, op, accepted FROM r WHERE n > 0")
def history_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return _judged_ops(spark, sf).select("analysis_id", "seq", "op", "accepted")


@query(
    "history_states",
    f"WITH RECURSIVE {_RUN[5:]} SELECT analysis_id, arg_max(at_status, n) AS status, arg_max(at_stage, n) AS stage, "
    "max(seq) FILTER (accepted AND op = 'bind_route') AS bound_at, max(seq) FILTER (accepted AND op = 'enqueue') AS queued_at, "
    "count(*) FILTER (NOT accepted) AS n_refused, min(seq) FILTER (NOT accepted) AS first_refused FROM r GROUP BY analysis_id",
)
def history_states(spark: SparkSession, sf: str) -> DataFrame:
    out = histories.last_states(_judged_ops(spark, sf))
    none = F.lit(lifecycle.NONE)
    return out.withColumns({"status": F.coalesce("state.status", none), "stage": F.coalesce("state.stage", none)}).drop("state")


_FILE = ("file_name", "file_bytes", "file_media")
#: Full joins of the distinct records, which the operator does without.
_AGREE = f"""{cte('accepted_v', 'held_source_v', 'verdict_v')},
t AS (SELECT analysis_id, sum(n) AS n, count(*) AS kinds, any_value(media_type) AS media_type, {', '.join(f"any_value({f}) AS {f}" for f in _FILE)}
  FROM (SELECT analysis_id, media_type, {', '.join(_FILE)}, count(*) AS n FROM accepted_v GROUP BY ALL) GROUP BY 1),
s AS (SELECT analysis_id, count(*) AS n FROM held_source_v GROUP BY 1),
v AS (SELECT analysis_id, sum(n) AS n, count(*) AS kinds, any_value(accepted) AS accepted, any_value(described) AS described, {', '.join(f"any_value({f}) AS {f}" for f in _FILE)}
  FROM (SELECT analysis_id, accepted, described, {', '.join(_FILE)}, count(*) AS n FROM verdict_v GROUP BY ALL) GROUP BY 1),
a AS (SELECT i.analysis_id, coalesce(t.n, 0)::BIGINT AS n_tasks, coalesce(s.n, 0)::BIGINT AS n_sources, coalesce(v.n, 0)::BIGINT AS n_validations,
  CASE WHEN t.n IS NULL THEN 'no_task' WHEN s.n IS NULL THEN 'no_source' WHEN v.n IS NULL THEN 'no_validation'
    WHEN t.kinds > 1 THEN 'several_tasks' WHEN v.kinds > 1 THEN 'several_validations'
    WHEN v.accepted IS NOT TRUE THEN 'not_accepted' WHEN NOT v.described THEN 'no_descriptor'
    WHEN t.file_name IS DISTINCT FROM v.file_name THEN 'descriptor:original_name'
    WHEN t.file_bytes <> v.file_bytes THEN 'descriptor:size_bytes'
    WHEN t.file_media <> v.file_media THEN 'descriptor:media_type'
    WHEN t.media_type <> t.file_media THEN 'media_type' END AS first_disagreement
  FROM (SELECT analysis_id FROM t UNION SELECT analysis_id FROM s UNION SELECT analysis_id FROM v) i
  LEFT JOIN t USING (analysis_id) LEFT JOIN s USING (analysis_id) LEFT JOIN v USING (analysis_id))"""


def _agreement(spark: SparkSession, sf: str) -> DataFrame:
    file = F.struct(
        F.col("file_name").alias("original_name"), F.col("file_bytes").alias("size_bytes"), F.col("file_media").alias("media_type")
    )
    tasks = view(spark, sf, "accepted_v").withColumn("validated_file", file)
    verdicts = view(spark, sf, "verdict_v").withColumn("validated_file", F.when(F.col("described"), file))
    return reconcile.agreement(tasks, view(spark, sf, "held_source_v"), verdicts)


@query("task_agreement", f"{_AGREE} SELECT * FROM a")
def task_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(spark, sf)


@query(
    "task_disagreements",
    f"{_AGREE} SELECT first_disagreement, count(*) AS n_ids, sum(n_tasks)::BIGINT AS n_tasks FROM a GROUP BY 1",
)
def task_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(spark, sf).groupBy("first_disagreement").agg(F.count("*").alias("n_ids"), F.sum("n_tasks").alias("n_tasks"))


@query(
    "rules_context",
    f"{cte('accepted_v')} SELECT analysis_id, config_snapshot_id = '' OR NOT regexp_matches(created_at, '(Z|\+00:00)$') "
    "OR coalesce(NOT regexp_matches(started_at, '(Z|\+00:00)$'), false) AS broken FROM accepted_v",
)
def rules_context(spark: SparkSession, sf: str) -> DataFrame:
    contexts = view(spark, sf, "accepted_v").select("analysis_id", "config_snapshot_id", "created_at", "started_at")
    judged = R.with_violations(contexts, R.context_rules(F.col, "created_at", "started_at"))
    return judged.select("analysis_id", F.array_contains("violations", "R29").alias("broken"))


@query(
    "start_once",
    f"{cte('state_v')}, c AS (SELECT analysis_id, "
    "count(*) FILTER (stage = 'preprocessing' AND has_start) AS starts, "
    "count(*) FILTER (stage = 'preprocessing' AND NOT has_start) AS unstamped_starts, "
    "count(*) FILTER (stage <> 'preprocessing' AND has_start) AS stray_starts, "
    "count(*) FILTER (stage = 'finished' AND has_finish) AS finishes, "
    "count(*) FILTER (stage = 'finished' AND NOT has_finish) AS unstamped_finishes, "
    "count(*) FILTER (stage <> 'finished' AND has_finish) AS stray_finishes, "
    "count(*) FILTER (cleanup_recorded) AS cleanup_records, "
    "count(*) FILTER (cleanup_recorded AND stage <> 'cleanup') AS stray_cleanup_records FROM state_v GROUP BY analysis_id) "
    "SELECT *, starts <= 1 AND unstamped_starts = 0 AND stray_starts = 0 AS start_ok, "
    "finishes <= 1 AND unstamped_finishes = 0 AND stray_finishes = 0 AS finish_ok, "
    "cleanup_records <= 1 AND stray_cleanup_records = 0 AS cleanup_ok FROM c",
)
def start_once(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_v").select(
        "analysis_id",
        "stage",
        F.when(F.col("has_start"), F.col("ts")).alias("started_at"),
        F.when(F.col("has_finish"), F.col("ts")).alias("finished_at"),
        "cleanup_recorded",
    )
    return lifecycle.stamp_report(events)


@query(
    "latest_state",
    f"{cte('state_v')} SELECT analysis_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(stage, seq) AS stage FROM state_v GROUP BY analysis_id",
)
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_v").select("analysis_id", "seq", "status", "stage")
    return lifecycle.latest_state(events)


@query(
    "backlog_rank",
    f"{cte('queue_v')} SELECT media_type, analysis_id, row_number() OVER (PARTITION BY media_type ORDER BY queued_at, analysis_id) AS fifo_position, "
    "row_number() OVER (PARTITION BY media_type ORDER BY queued_at, analysis_id) <= CASE media_type "
    + " ".join(f"WHEN '{m}' THEN {PARAMS.capacity(m)}" for m in vocab.MEDIA_TYPES)
    + " END AS within_capacity FROM queue_v WHERE status = 'queued' AND stage = 'queued'",
)
def backlog_rank(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.backlog(view(spark, sf, "queue_v"), PARAMS).select(
        "media_type", "analysis_id", "fifo_position", "within_capacity"
    )


@query(
    "pending_by_media",
    f"{cte('queue_v')} SELECT media_type, count(*) AS n_pending FROM queue_v WHERE status = 'queued' AND stage = 'queued' GROUP BY media_type",
)
def pending_by_media(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.pending_by_media(view(spark, sf, "queue_v"))


@query(
    "dup_ids",
    "SELECT l_orderkey AS analysis_id, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.duplicate_ids(
        read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id"))
    )


@query(
    "admit_new",
    "SELECT user_id AS analysis_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events "
    "WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id",
)
def admit_new(spark: SparkSession, sf: str) -> DataFrame:
    incoming = read(spark, sf, "events").select(
        F.col("user_id").alias("analysis_id"), "event_id", "event_type"
    )
    known = (
        read(spark, sf, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("analysis_id"))
    )
    return lifecycle.admit(incoming, known, "event_id")


_BINDINGS = [("image", "image"), ("video", "video")]


@query(
    "route_bound",
    f"{cte('queue_v')} SELECT event_id, media_type, CASE WHEN media_type <> 'audio' THEN media_type END AS bound_route FROM queue_v",
)
def route_bound(spark: SparkSession, sf: str) -> DataFrame:
    bindings = spark.createDataFrame(_BINDINGS, "media_type string, bound_route string")
    tasks = view(spark, sf, "queue_v").select("event_id", "media_type")
    return lifecycle.bind_routes(tasks, bindings).select("event_id", "media_type", "bound_route")


@query(
    "route_unbound",
    f"{cte('queue_v')} SELECT event_id, media_type FROM queue_v WHERE media_type NOT IN ('image', 'video')",
)
def route_unbound(spark: SparkSession, sf: str) -> DataFrame:
    bindings = spark.createDataFrame(_BINDINGS, "media_type string, route string")
    tasks = view(spark, sf, "queue_v").select("event_id", "media_type")
    return lifecycle.unbound(tasks, bindings).select("event_id", "media_type")


@query(
    "rules_route",
    f"{cte('queue_v')} SELECT event_id FROM queue_v WHERE (route IS NOT NULL AND route <> media_type) OR stage = 'routing'",
)
def rules_route(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.route_violations(view(spark, sf, "queue_v")).select("event_id")


@query(
    "execution_outcomes",
    f"{cte('analyzer_v')} SELECT event_id, CASE WHEN status = 'completed' THEN n_errors = 0 "
    "WHEN status = 'error' THEN n_errors > 0 ELSE false END AS consistent FROM analyzer_v",
)
def execution_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    return view(spark, sf, "analyzer_v").select(
        "event_id", gate.execution_is_consistent(status, F.col("n_errors")).alias("consistent")
    )


@query(
    "task_snapshot",
    f"{cte('queue_v')} SELECT event_id, analysis_id, media_type, status, stage, route, "
    "CASE WHEN event_id % 10 = 9 THEN 'e' || event_id END AS first_error, CASE WHEN event_id % 10 = 9 THEN 4 END AS n_error_fields, "
    "event_type AS channel FROM queue_v",
)
def task_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    def error() -> Column:
        return F.struct(
            F.concat(F.lit("e"), F.col("event_id")).alias("code"),
            F.lit("internal").alias("category"),
            F.lit("m").alias("message"),
            F.lit(True).alias("retryable"),
            F.lit("file").alias("field"),
            F.lit("/secret/path").alias("workspace_path"),
        )

    null = F.lit(None)
    tasks = view(spark, sf, "queue_v").select(
        "event_id",
        "analysis_id",
        F.col("ts").alias("created_at"),
        "status",
        "stage",
        F.struct(F.col("event_type").alias("channel")).alias("source"),
        "media_type",
        F.lit(PARAMS.fingerprint()).alias("config_snapshot_id"),
        "queued_at",
        null.cast("timestamp").alias("started_at"),
        null.cast("timestamp").alias("finished_at"),
        "route",
        F.struct(F.lit("failed").alias("status"), F.array(error()).alias("errors")).alias("cleanup"),
        F.when(F.col("event_id") % 10 == 9, F.array(error())).alias("errors"),
        F.lit("/secret").alias("workspace_path"),
    )
    snap = lifecycle.snapshots(tasks)
    first = F.get(F.col("errors"), F.lit(0))
    return snap.select(
        "analysis_id",
        "media_type",
        "status",
        "stage",
        "route",
        first["code"].alias("first_error"),
        F.when(first.isNotNull(), F.size(F.json_object_keys(F.to_json(first)))).alias("n_error_fields"),
        F.col("source.channel").alias("channel"),
    ).join(tasks.select("analysis_id", "event_id"), "analysis_id")


# --- retention -------------------------------------------------------------------------------------
AS_OF = "2024-01-30 00:00:00"
_PLAN = f"""{cte('workspace_v')}, p AS (
  SELECT event_id, analysis_id, location,
    regexp_matches(analysis_id, '^[0-9a-f]{{32}}$') AND NOT is_symlink AND is_dir AS trusted,
    mtime <= TIMESTAMP '{AS_OF}' - CASE location WHEN 'quarantine' THEN INTERVAL {PARAMS.quarantine_ttl_hours} HOUR
      ELSE INTERVAL {PARAMS.workspace_ttl_minutes} MINUTE END AS expired,
    coalesce(task_stage, 'finished') <> 'finished' AS busy
  FROM workspace_v),
plan AS (SELECT event_id, analysis_id, location,
    CASE WHEN NOT trusted OR expired IS NULL THEN 'report' WHEN expired AND NOT busy THEN 'delete' ELSE 'keep' END AS action,
    CASE WHEN NOT trusted THEN location || '_entry_unsafe' WHEN expired IS NULL THEN location || '_age_unavailable' END AS issue_code,
    CASE WHEN trusted THEN analysis_id END AS reported_id FROM p)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    entries = view(spark, sf, "workspace_v")
    tasks = entries.where("task_stage IS NOT NULL").select(
        "analysis_id", F.col("task_stage").alias("stage")
    )
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return retention.retention_plan(
        entries.select("event_id", "analysis_id", "location", "mtime", "is_symlink", "is_dir"),
        lifecycle.active(tasks),
        as_of,
        PARAMS,
    )


@query("retention_plan", f"{_PLAN} SELECT event_id, action, issue_code, reported_id FROM plan")
def retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select("event_id", "action", "issue_code", "reported_id")


@query(
    "retention_summary",
    f"{_PLAN} SELECT location, action, issue_code, count(*) AS n_entries, min(reported_id) AS first_id, max(reported_id) AS last_id FROM plan GROUP BY ALL",
)
def retention_summary(spark: SparkSession, sf: str) -> DataFrame:
    return retention.sweep_counts(_plan(spark, sf))


@query(
    "sweep_listing",
    f"{_PLAN} SELECT location, action, analysis_id, row_number() OVER (PARTITION BY location, action ORDER BY analysis_id) AS position FROM plan WHERE action <> 'keep' AND reported_id IS NOT NULL",
)
def sweep_listing(spark: SparkSession, sf: str) -> DataFrame:
    return retention.sweep_listing(_plan(spark, sf))


@query(
    "recover_decision",
    f"{cte('attempt_v')} SELECT analysis_id, count(*) AS n_attempts, bool_or(ok) AS deleted, CASE WHEN bool_or(ok) THEN 'deleted' "
    f"WHEN count(*) >= {1 + PARAMS.cleanup_retries} THEN 'quarantined' ELSE 'retry' END AS decision FROM attempt_v GROUP BY analysis_id",
)
def recover_decision(spark: SparkSession, sf: str) -> DataFrame:
    return retention.recovery_decision(view(spark, sf, "attempt_v").select("analysis_id", "ok"), PARAMS)


@query(
    "cleanup_rollup",
    f"{cte('attempt_v')}, c AS (SELECT analysis_id, coalesce(bool_and(deleted) FILTER (kind = 'original'), false) AS original_file_deleted, "
    "coalesce(bool_and(deleted) FILTER (kind = 'intermediate'), true) AS intermediate_files_deleted FROM attempt_v GROUP BY analysis_id) "
    "SELECT *, CASE WHEN original_file_deleted AND intermediate_files_deleted THEN 'completed' "
    "WHEN original_file_deleted OR intermediate_files_deleted THEN 'partial' ELSE 'failed' END AS status FROM c",
)
def cleanup_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return retention.cleanup_rollup(view(spark, sf, "attempt_v").select("analysis_id", "kind", "deleted"))


@query(
    "obligations_left",
    f"{cte('attempt_v')} SELECT DISTINCT analysis_id, artifact_id FROM attempt_v WHERE (analysis_id, artifact_id) NOT IN "
    "(SELECT (analysis_id, artifact_id) FROM attempt_v WHERE ok)",
)
def obligations_left(spark: SparkSession, sf: str) -> DataFrame:
    attempts = view(spark, sf, "attempt_v").select("analysis_id", "artifact_id", "ok")
    registered = attempts.select("analysis_id", "artifact_id").distinct()
    return retention.outstanding(registered, attempts.where("ok"))


# --- logs -------------------------------------------------------------------------------------------
@query(
    "log_rows",
    f"{cte('log_v')} SELECT '{{\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(microsecond(ts) % 1000000 / 1000)::INT AS VARCHAR), 3, '0') || 'Z\",\"level\":\"' || level || "
    "'\",\"logger\":\"' || logger || '\",\"event\":\"' || coalesce(event, 'log') || '\",\"message\":\"' || message || '\"' || "
    "CASE WHEN host IS NULL THEN '' ELSE ',\"host\":\"' || host || '\",\"port\":' || port END || '}' AS value FROM log_v",
)
def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "log_v")
    return logs.log_line(events, F.col("ts"))


@query(
    "rules_log",
    f"{cte('log_v')} SELECT event_id, CASE WHEN event IN ('result_saved', 'analyzer_finished') THEN '' ELSE 'R34' END AS violations FROM log_v",
)
def rules_log(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_violations(view(spark, sf, "log_v"), R.log_rules(F.col)).select(
        "event_id", F.array_join("violations", ",").alias("violations")
    )
