"""Queries over analyzer runs, findings, completeness, risk, documents and grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions import text as X
from mediasift.operators import analyzers, assess, findings, grids, retention
from mediasift.params import Params
from mediasift.plans.registry import PARAMS, query
from mediasift.plans.views import cte, derive, read, view
from mediasift.sources import results

OVERRIDE = Params(override_enabled=True, override_finding_types=("splice",))

_COUNTS = (
    "count(*) AS planned_analyzers, count(*) FILTER (applicable) AS applicable_analyzers, "
    "count(*) FILTER (status = 'completed') AS completed_analyzers, count(*) FILTER (status = 'error') AS failed_analyzers, "
    "count(*) FILTER (status = 'timeout') AS timed_out_analyzers, count(*) FILTER (status = 'skipped') AS skipped_analyzers, "
    "count(*) FILTER (status = 'not_applicable') AS not_applicable_analyzers, "
    "coalesce(CAST(count(*) FILTER (applicable AND status = 'completed') AS DOUBLE) / nullif(count(*) FILTER (applicable), 0), 0.0) AS coverage_ratio"
)


def _completeness(name: str) -> str:
    return (
        f"c0 AS (SELECT analysis_id, {_COUNTS} FROM {name} GROUP BY analysis_id), "
        "comp AS (SELECT *, CASE WHEN applicable_analyzers = 0 THEN 'insufficient' WHEN coverage_ratio >= 1 THEN 'complete' "
        f"WHEN coverage_ratio >= {PARAMS.minimum_coverage} THEN 'partial' ELSE 'insufficient' END AS completeness_status FROM c0)"
    )


def _risk(name: str) -> str:
    weight = f"CASE severity WHEN 'weak' THEN {PARAMS.weak_score} WHEN 'significant' THEN {PARAMS.significant_score} ELSE 0 END"
    eligible = "critical_override_eligible AND severity = 'critical' AND type = 'splice'"
    return (
        f"g AS (SELECT analysis_id, correlation_group IS NULL AS alone, coalesce(correlation_group, finding_id) AS grp, max({weight}) AS w, count(*) AS n, "
        f"count(*) FILTER ({eligible}) AS crit, min(finding_id) FILTER ({eligible}) AS first_crit "
        f"FROM {name} GROUP BY ALL), "
        "risk AS (SELECT analysis_id, CAST(sum(w) AS DOUBLE) AS score, CAST(sum(n) AS BIGINT) AS n_findings, "
        "CAST(sum(crit) AS BIGINT) AS n_override_findings, min(first_crit) AS first_override_finding FROM g GROUP BY analysis_id)"
    )


_LEVEL = f"CASE WHEN score <= {PARAMS.low_max} THEN 'low' WHEN score <= {PARAMS.medium_max} THEN 'medium' ELSE 'high' END"
_ASSESSED = (
    f"{cte('order_analyzer_v', 'order_finding_v')}, {_completeness('order_analyzer_v')}, {_risk('order_finding_v')}, "
    "a AS (SELECT comp.*, coalesce(score, 0.0) AS score, coalesce(n_findings, 0) AS n_findings, "
    "coalesce(n_override_findings, 0) AS n_override_findings, first_override_finding FROM comp LEFT JOIN risk USING (analysis_id)), "
    f"b AS (SELECT *, CASE WHEN completeness_status IN ('complete', 'partial') THEN {_LEVEL} END AS score_based_level, "
    "completeness_status IN ('complete', 'partial') AND n_override_findings > 0 AS critical_override_applied FROM a), "
    "f AS (SELECT *, CASE WHEN critical_override_applied THEN 'high' ELSE score_based_level END AS final_level FROM b)"
)


_ANALYSES = (
    "SELECT CAST(c_custkey AS STRING) AS analysis_id, CASE c_custkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' "
    "ELSE 'completed' END AS status FROM customer"
)
_COUNTERS = "planned applicable completed failed timed_out skipped not_applicable".split()


@query(
    "completeness_of_all",
    f"{cte('analyzer_v')}, {_completeness('analyzer_v')}, "
    f"every_v AS ({_ANALYSES.replace('STRING', 'VARCHAR')}) SELECT analysis_id, "
    + ", ".join(f"coalesce({c}_analyzers, 0) AS {c}_analyzers" for c in _COUNTERS)
    + ", coalesce(coverage_ratio, 0.0) AS coverage_ratio, CASE WHEN planned_analyzers IS NULL THEN "
    "CASE WHEN status = 'completed' THEN 'insufficient' ELSE 'not_assessed' END ELSE completeness_status END AS completeness_status "
    "FROM every_v LEFT JOIN comp USING (analysis_id)",
)
def completeness_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses with and without a run: most customers have no event, which stands for a run."""
    every = read(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS analysis_id",
        "CASE c_custkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' ELSE 'completed' END AS status",
    )
    return assess.completeness(view(spark, sf, "analyzer_v"), PARAMS, analyses=every)


@query("completeness", f"{cte('analyzer_v')}, {_completeness('analyzer_v')} SELECT * FROM comp")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return assess.completeness(view(spark, sf, "analyzer_v"), PARAMS)


@query(
    "coverage",
    f"{cte('order_analyzer_v')}, {_completeness('order_analyzer_v')} SELECT completeness_status, count(*) AS n_analyses, "
    "min(coverage_ratio) AS min_ratio, max(coverage_ratio) AS max_ratio FROM comp GROUP BY completeness_status",
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return (
        assess.completeness(view(spark, sf, "order_analyzer_v"), PARAMS)
        .groupBy("completeness_status")
        .agg(
            F.count("*").alias("n_analyses"),
            F.min("coverage_ratio").alias("min_ratio"),
            F.max("coverage_ratio").alias("max_ratio"),
        )
    )


@query("risk_score", f"{cte('finding_v')}, {_risk('finding_v')} SELECT * FROM risk")
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return assess.risk_scores(view(spark, sf, "finding_v"), OVERRIDE)


def _assessed(spark: SparkSession, sf: str, of=view) -> DataFrame:
    return assess.assess(
        assess.completeness(of(spark, sf, "order_analyzer_v"), OVERRIDE),
        of(spark, sf, "order_finding_v"),
        OVERRIDE,
    )


@query(
    "risk_level",
    f"{_ASSESSED} SELECT analysis_id, score, n_findings, score_based_level, critical_override_applied, final_level, "
    f"CAST(NULL AS DOUBLE) AS probability, '{PARAMS.policy_version}' AS policy_version FROM f",
)
def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select(
        "analysis_id",
        "score",
        "n_findings",
        "score_based_level",
        "critical_override_applied",
        "final_level",
        "probability",
        "policy_version",
    )


@query(
    "override",
    f"{cte('order_finding_v')} SELECT analysis_id, finding_id FROM order_finding_v WHERE critical_override_eligible AND severity = 'critical' AND type = 'splice'",
)
def override(spark: SparkSession, sf: str) -> DataFrame:
    return assess.override_findings(view(spark, sf, "order_finding_v"), OVERRIDE)


_POLICY = """
CASE WHEN completeness_status = 'insufficient' THEN 'request_better_quality_source'
     WHEN final_level = 'high' THEN 'escalate_to_security' WHEN final_level = 'medium' THEN 'manual_review'
     WHEN completeness_status = 'complete' THEN 'no_additional_action' ELSE 'verify_source' END
"""


@query(
    "recommend",
    f"{_ASSESSED} SELECT analysis_id, {_POLICY} AS primary_action, completeness_status = 'insufficient' OR final_level <> 'low' AS requires_manual_review FROM f",
)
def recommend(spark: SparkSession, sf: str) -> DataFrame:
    return assess.recommend(_assessed(spark, sf)).select(
        "analysis_id", "primary_action", "requires_manual_review"
    )


@query(
    "result_status",
    f"{_ASSESSED} SELECT analysis_id, CASE completeness_status WHEN 'complete' THEN 'completed' WHEN 'partial' THEN 'partial' ELSE 'failed' END AS status FROM f",
)
def result_status(spark: SparkSession, sf: str) -> DataFrame:
    done = assess.completeness(view(spark, sf, "order_analyzer_v"), PARAMS)
    return done.select(
        "analysis_id",
        assess.result_status(F.lit("accepted"), F.col("completeness_status")).alias("status"),
    )


@query(
    "durations",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) * 86400000 AS duration_ms "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def durations(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        assess.duration_ms(F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_ms"),
    )


@query(
    "orphans",
    f"{cte('finding_v', 'analyzer_v')} SELECT f.analysis_id, source_analyzer_id, source_analyzer_version, count(*) AS n_findings FROM finding_v f "
    "WHERE NOT EXISTS (SELECT 1 FROM analyzer_v a WHERE a.analysis_id = f.analysis_id AND a.analyzer_id = f.source_analyzer_id "
    "AND a.analyzer_version = f.source_analyzer_version) GROUP BY ALL",
)
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return findings.orphan_sources(view(spark, sf, "finding_v"), view(spark, sf, "analyzer_v"))


@query(
    "dangling_critical",
    "SELECT CAST(o_orderkey AS VARCHAR) AS analysis_id, CAST(c AS VARCHAR) AS finding_id FROM "
    "(SELECT o_orderkey, unnest([o_custkey, o_orderkey]) AS c FROM orders) WHERE NOT EXISTS "
    "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = c)",
)
def dangling_critical(spark: SparkSession, sf: str) -> DataFrame:
    claims = read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("analysis_id"),
        F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias(
            "critical_finding_ids"
        ),
    )
    known = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("analysis_id"),
        F.col("l_partkey").cast("string").alias("finding_id"),
    )
    return findings.dangling_critical_ids(claims, known)


@query(
    "finding_formation",
    "SELECT event_id, CAST(user_id AS VARCHAR) AS analysis_id, event_type || '-' || i AS finding_id, event_type AS source_analyzer_id, "
    "CASE WHEN i = 0 THEN 'weak' ELSE 'significant' END AS severity, CASE WHEN i = 1 THEN event_id % 7 END AS end_frame, value AS source_score "
    "FROM (SELECT *, unnest(range(0, event_id % 3)) AS i FROM events)",
)
def finding_formation(spark: SparkSession, sf: str) -> DataFrame:
    runs = read(spark, sf, "events").select(
        F.concat_ws("|", F.col("user_id"), F.col("event_id")).alias("analysis_id"),
        F.col("event_type").alias("analyzer_id"),
        F.lit("1.0").alias("analyzer_version"),
        F.lit("g").alias("group"),
        F.col("value").alias("score"),
        F.slice(
            F.array(
                F.lit('{"type":"splice","severity":"weak"}'),
                F.concat(
                    F.lit('{"type":"cut","severity":"significant","localization":{"type":"frame_interval","start_frame":0,"end_frame":'),
                    (F.col("event_id") % 7).cast("string"),
                    F.lit("}}"),
                ),
            ),
            F.lit(1),
            (F.col("event_id") % 3).cast("int"),
        ).alias("candidate_findings"),
    )
    formed = findings.form_findings(runs)
    key = F.split("analysis_id", r"\|")
    return formed.select(
        key[1].cast("bigint").alias("event_id"),
        key[0].alias("analysis_id"),
        "finding_id",
        "source_analyzer_id",
        "severity",
        F.col("localization.end_frame").alias("end_frame"),
        "source_score",
    )


@query(
    "missing_caps",
    f"{cte('order_analyzer_v')} SELECT analysis_id, 'cap' || analyzer_id AS capability FROM order_analyzer_v "
    "WHERE analyzer_id IN ('a1', 'a2', 'a3') GROUP BY ALL HAVING NOT bool_or(status = 'completed')",
)
def missing_caps(spark: SparkSession, sf: str) -> DataFrame:
    catalog = spark.createDataFrame(
        [("a1", "capa1", True), ("a2", "capa2", True), ("a3", "capa3", True), ("a4", "capa4", False)],
        "analyzer_id string, capability string, required boolean",
    )
    return assess.missing_capabilities(catalog, view(spark, sf, "order_analyzer_v"))


# --- documents -------------------------------------------------------------------------------------
def _together(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view of the lines with those of an analysis in one partition: only bare columns are shuffled, and what is
    counted, gathered and joined by analysis afterwards needs no further shuffle. The number of partitions is
    stated: bare columns are small, so that Spark would put them together into few tasks, and documents are not."""
    lines, partitions = read(spark, sf, "lineitem"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return derive(lines.repartition(partitions, F.col("l_orderkey").cast("string")), name)


def document_heads(spark: SparkSession, sf: str, of=view) -> DataFrame:
    """Every field of the result documents of orders but the nested lists."""
    assessed = assess.risk_record(assess.recommend(_assessed(spark, sf, of)))
    none = F.array().cast("array<string>")
    noon = F.lit("2026-01-01T12:00:00Z")
    errors = F.when(
        F.col("completeness_status") == "insufficient",
        F.array(
            F.struct(
                F.lit("insufficient_coverage").alias("code"),
                F.lit("processing").alias("category"),
                F.lit("Too few analyzers completed.").alias("message"),
                F.lit(True).alias("retryable"),
            )
        ),
    ).otherwise(F.array())
    image = F.struct(
        F.lit(10).alias("width"),
        F.lit(10).alias("height"),
        F.lit("PNG").alias("format"),
        F.lit("RGB").alias("color_mode"),
        F.lit(False).alias("has_metadata"),
    )
    file = F.struct(
        F.lit("a.png").alias("original_name"),
        F.lit("png").alias("extension"),
        F.lit(None).cast("string").alias("declared_mime_type"),
        F.lit("image/png").alias("detected_mime_type"),
        F.lit("image").alias("media_type"),
        F.lit(10).alias("size_bytes"),
        F.sha2("analysis_id", 256).alias("sha256"),
        F.lit(True).alias("signature_match"),
        F.lit(True).alias("safe_read"),
        image.alias("technical_parameters"),
    )
    return assessed.select(
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        "analysis_id",
        noon.alias("created_at"),
        noon.alias("updated_at"),
        assess.result_status(F.lit("accepted"), F.col("completeness_status")).alias("status"),
        F.lit("finished").alias("stage"),
        F.struct(F.lit("api").alias("channel")).alias("source"),
        file.alias("file"),
        F.struct(
            noon.alias("queued_at"),
            noon.alias("started_at"),
            noon.alias("finished_at"),
            F.lit(0).alias("duration_ms"),
            F.lit(OVERRIDE.fingerprint()).alias("config_snapshot_id"),
            F.lit("1").alias("application_version"),
        ).alias("processing"),
        "completeness",
        "risk_assessment",
        "recommendation",
        F.struct(
            F.lit("completed").alias("status"),
            F.lit(True).alias("original_file_deleted"),
            F.lit(True).alias("intermediate_files_deleted"),
            F.lit(False).alias("quarantine_used"),
            noon.alias("finished_at"),
            F.array().alias("errors"),
        ).alias("cleanup"),
        none.alias("warnings"),
        errors.alias("errors"),
        "first_override_finding",
    )


def document_children(spark: SparkSession, sf: str, of=view) -> tuple[DataFrame, DataFrame]:
    text = F.lit(None).cast("string")
    failed = F.col("status").isin("error", "timeout")
    error = F.struct(
        F.lit("analyzer_failed").alias("code"),
        F.lit("analyzer").alias("category"),
        F.lit("The analyzer failed.").alias("message"),
        F.lit(True).alias("retryable"),
    )
    runs = of(spark, sf, "order_analyzer_v").select(
        "analysis_id",
        "analyzer_id",
        F.lit("1.0").alias("analyzer_version"),
        F.lit("image").alias("media_type"),
        F.lit("g").alias("group"),
        "status",
        "applicable",
        text.alias("started_at"),
        text.alias("finished_at"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.col("l_tax").alias("score"),
        F.lit("likelihood").alias("score_name"),
        F.lit("run").alias("summary"),
        F.parse_json(F.lit("{}")).alias("raw_metrics"),
        F.array().alias("candidate_findings"),
        F.array().cast("array<string>").alias("warnings"),
        F.when(failed, F.array(error)).otherwise(F.array()).alias("errors"),
    )
    found = of(spark, sf, "order_finding_v").select(
        "analysis_id",
        "finding_id",
        F.lit("g").alias("group"),
        "type",
        "severity",
        F.concat(F.lit("a"), F.col("l_linenumber")).alias("source_analyzer_id"),
        F.lit("1.0").alias("source_analyzer_version"),
        F.lit("").alias("description"),
        F.struct(F.lit("file").alias("type")).alias("localization"),
        F.col("l_discount").alias("source_score"),
        F.lit(None).cast("double").alias("score_impact"),
        "critical_override_eligible",
        "correlation_group",
        F.array().cast("array<string>").alias("evidence_refs"),
        (
            F.col("critical_override_eligible")
            & (F.col("severity") == "critical")
            & (F.col("type") == "splice")
        ).alias("_critical"),
    )
    return runs, found


def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of orders: analysis_id, n_analyzers, n_findings, doc."""
    return assess.assemble(document_heads(spark, sf, _together), *document_children(spark, sf, _together))


@query(
    "assemble",
    f"{_ASSESSED} SELECT analysis_id, CAST(planned_analyzers AS INT) AS n_analyzers, "
    "CAST(n_findings AS INT) AS n_findings, final_level, CAST(n_override_findings AS INT) AS n_critical FROM f",
)
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    docs = result_documents(spark, sf)
    risk = F.from_json(
        F.get_json_object("doc", "$.risk_assessment"),
        "final_level string, critical_finding_ids array<string>",
    )
    return docs.withColumn("risk", risk).select(
        "analysis_id",
        "n_analyzers",
        "n_findings",
        F.col("risk.final_level").alias("final_level"),
        F.size("risk.critical_finding_ids").alias("n_critical"),
    )


@query(
    "document_rows",
    f"{cte('order_analyzer_v', 'order_finding_v')} SELECT DISTINCT analysis_id, 'head' AS section, NULL AS child_id, false AS critical FROM order_analyzer_v "
    "UNION ALL SELECT analysis_id, 'analyzers', analyzer_id, false FROM order_analyzer_v UNION ALL SELECT analysis_id, 'findings', finding_id, "
    "critical_override_eligible AND severity = 'critical' AND type = 'splice' FROM order_finding_v",
)
def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = assess.document_rows(document_heads(spark, sf), *document_children(spark, sf))
    return rows.where("json IS NOT NULL").select("analysis_id", "section", "child_id", "critical")


@query(
    "documents_valid",
    f"{_ASSESSED} SELECT completeness_status, count(*) AS n_documents, count(*) FILTER (CAST(analysis_id AS BIGINT) % 7 < 3) AS n_invalid, CAST(sum(planned_analyzers) FILTER (CAST(analysis_id AS BIGINT) % 7 <> 1) AS BIGINT) AS n_analyzers, "
    "CAST(sum(n_findings) FILTER (CAST(analysis_id AS BIGINT) % 7 <> 1) AS BIGINT) AS n_findings FROM f GROUP BY completeness_status",
)
def documents_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Built documents are read back as stored results and judged by every rule; three in seven are damaged before:
    another schema version, an unknown field (which leaves a document without a typed result), an unknown channel."""
    kind, doc = F.col("analysis_id").cast("long") % 7, F.col("doc")
    damaged = (
        F.when(kind == 0, F.replace(doc, F.lit('"schema_version":"1.0"'), F.lit('"schema_version":"2.0"')))
        .when(kind == 1, F.concat(F.lit('{"extra":1,'), F.substring(doc.cast("binary"), F.lit(2), F.octet_length(doc)).cast("string")))
        .when(kind == 2, F.replace(doc, F.lit('"channel":"'), F.lit('"channel":"x')))
        .otherwise(doc)
    )
    docs, r = result_documents(spark, sf).select(damaged.alias("doc")), F.col("result")
    # a document without a typed result is asked for its text
    stated = F.coalesce(r["completeness"]["status"], F.get_json_object("doc", "$.completeness.status"))
    return (
        results.judge(docs, typed_as=schemas.JUDGED)
        .groupBy(stated.alias("completeness_status"))
        .agg(
            F.count("*").alias("n_documents"),
            F.count_if(F.size("violations") > 0).alias("n_invalid"),
            F.sum(F.size(r["analyzers"])).alias("n_analyzers"),
            F.sum(F.size(r["findings"])).alias("n_findings"),
        )
    )


@query(
    "flatten_findings",
    f"{cte('order_finding_v')} SELECT analysis_id, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY finding_id) - 1 AS INT) AS pos, finding_id, severity FROM order_finding_v",
)
def flatten_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents back to one row per finding."""
    asked = "analysis_id string, findings array<struct<finding_id:string,severity:string>>"
    typed = result_documents(spark, sf).select(F.from_json("doc", asked).alias("result"))
    return findings.flatten_array(typed, "findings").select(
        "analysis_id", "pos", "finding_id", "severity"
    )


# --- analyzers ----------------------------------------------------------------------------------------
_MEDIA = (
    "m AS (SELECT 'm' || doc_id AS analysis_id, "
    "CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS media_type, "
    "CASE WHEN doc_id % 3 > 0 THEN CAST(1 + n_chars % 90 AS DOUBLE) / 2 END AS duration_seconds, "
    "doc_id % 4 <> 0 AS has_audio, n_chars FROM documents)"
)


def _media(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").selectExpr(
        "'m' || doc_id AS analysis_id",
        "CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS media_type",
        "CASE WHEN doc_id % 3 > 0 THEN CAST(1 + n_chars % 90 AS DOUBLE) / 2 END AS duration_seconds",
        "doc_id % 4 <> 0 AS has_audio",
        "n_chars AS size_bytes",
        "lang AS sha256",
    )


_CATALOG = [
    ("noise", "1.0", "image", "pixels", True, None),
    ("edges", "1.0", "image", "pixels", False, None),
    ("speech", "1.1", "audio", "sound", True, 5.0),
    ("frames", "2.0", "video", "motion", True, 10.0),
    ("broken", "1.0", "video", "motion", True, None),
]


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        _CATALOG,
        "analyzer_id string, analyzer_version string, media_type string, `group` string, "
        "enabled boolean, min_seconds double",
    ).withColumn("settings", F.lit('{"timeout_seconds":120}'))


_CATALOG_SQL = (
    "c AS (SELECT * FROM (VALUES ('noise', 'image', true, NULL), ('edges', 'image', false, NULL), ('speech', 'audio', true, 5.0), "
    "('frames', 'video', true, 10.0), ('broken', 'video', true, NULL)) AS c(analyzer_id, media_type, enabled, min_seconds)), "
    "plan AS (SELECT m.*, analyzer_id, enabled, min_seconds IS NULL OR coalesce(duration_seconds, 0) >= min_seconds AS applicable FROM m JOIN c USING (media_type))"
)


def _score(rows: pd.DataFrame) -> pd.DataFrame:
    score = (rows["size_bytes"] % 100) / 100.0
    return pd.DataFrame(
        {
            "score": score,
            "score_name": "likelihood",
            "summary": "done",
            "raw_metrics": "{}",
            "candidate_findings": [['{"type":"splice"}'] if s > 0.5 else [] for s in score],
        }
    )


def _fail_some(rows: pd.DataFrame) -> pd.DataFrame:
    if (rows["size_bytes"] % 2 == 0).any():
        raise ValueError("unreadable")
    return _score(rows)


REGISTRY = {
    a: analyzers.Analyzer(a, v, m, g, _fail_some if a == "broken" else _score)
    for a, v, m, g, _, _ in _CATALOG
}


@query(
    "analyzer_requests",
    f"WITH {_MEDIA}, {_CATALOG_SQL}, arts AS (SELECT *, CAST(CASE media_type WHEN 'image' THEN 2 WHEN 'audio' THEN 2 + ceil(duration_seconds / 10) "
    "ELSE 1 + ceil(duration_seconds / 2) + CASE WHEN has_audio THEN 1 ELSE 0 END END AS BIGINT) AS n_artifacts FROM plan) "
    "SELECT analysis_id, analyzer_id, n_artifacts FROM arts WHERE applicable AND enabled",
)
def analyzer_requests(spark: SparkSession, sf: str) -> DataFrame:
    return analyzers.requests(_media(spark, sf), _catalog(spark), PARAMS).select(
        "analysis_id", "analyzer_id", "n_artifacts"
    )


@query(
    "analyzer_run",
    f"WITH {_MEDIA}, {_CATALOG_SQL}, r AS (SELECT *, analyzer_id = 'broken' AND n_chars % 2 = 0 AS bad FROM plan WHERE applicable AND enabled) "
    "SELECT analysis_id, analyzer_id, CASE WHEN bad THEN 'error' ELSE 'completed' END AS status, "
    "CASE WHEN NOT bad THEN CAST(n_chars % 100 AS DOUBLE) / 100 END AS score, CASE WHEN bad THEN 'analyzer_failed' END AS error_code, "
    "CAST(CASE WHEN NOT bad AND n_chars % 100 > 50 THEN 1 ELSE 0 END AS INT) AS n_candidates FROM r",
)
def analyzer_run(spark: SparkSession, sf: str) -> DataFrame:
    asked = analyzers.requests(_media(spark, sf), _catalog(spark), PARAMS)
    return analyzers.run(asked, REGISTRY).select(
        "analysis_id",
        "analyzer_id",
        "status",
        "score",
        "error_code",
        F.size("candidate_findings").alias("n_candidates"),
    )


@query(
    "analyzer_plan",
    f"WITH {_MEDIA}, {_CATALOG_SQL} SELECT analysis_id, analyzer_id, applicable, CASE WHEN NOT applicable THEN 'not_applicable' WHEN NOT enabled THEN 'skipped' "
    "WHEN n_chars % 10 = 0 THEN 'timeout' ELSE 'completed' END AS status FROM plan",
)
def analyzer_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = analyzers.planned(_media(spark, sf), _catalog(spark))
    executed = plan.where("planned_status IS NULL AND size_bytes % 10 <> 0").select(
        "analysis_id", "analyzer_id", F.lit("completed").alias("status")
    )
    return analyzers.complete_plan(plan, executed).select(
        "analysis_id", "analyzer_id", "applicable", "status"
    )


# --- grids -----------------------------------------------------------------------------------------------
@query(
    "fragments",
    f"WITH {_MEDIA} SELECT analysis_id, i AS fragment, CAST(i * 10 AS DOUBLE) AS start_seconds, least((i + 1) * 10.0::DOUBLE, duration_seconds) AS end_seconds "
    "FROM (SELECT *, unnest(range(0, CAST(ceil(duration_seconds / 10) AS BIGINT))) AS i FROM m WHERE media_type = 'audio')",
)
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    return grids.audio_fragments(_media(spark, sf), PARAMS)


@query(
    "keyframes",
    f"WITH {_MEDIA} SELECT analysis_id, i AS keyframe, CAST(i * 2 AS DOUBLE) AS at_seconds "
    "FROM (SELECT *, unnest(range(0, CAST(ceil(duration_seconds / 2) AS BIGINT))) AS i FROM m WHERE media_type = 'video')",
)
def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return grids.video_keyframes(_media(spark, sf), PARAMS)


_ARTIFACTS = (
    f"WITH {_MEDIA}, art AS ("
    "SELECT analysis_id, 'audio_fragment_' || unnest(range(0, CAST(ceil(duration_seconds / 10) AS BIGINT))) AS artifact_id, 'audio_fragment' AS artifact_type FROM m WHERE media_type = 'audio' "
    "UNION ALL SELECT analysis_id, 'key_frame_' || unnest(range(0, CAST(ceil(duration_seconds / 2) AS BIGINT))), 'key_frame' FROM m WHERE media_type = 'video' "
    "UNION ALL SELECT analysis_id, 'normalized_image', 'normalized_image' FROM m WHERE media_type = 'image' "
    "UNION ALL SELECT analysis_id, 'spectrogram', 'spectrogram' FROM m WHERE media_type = 'audio' "
    "UNION ALL SELECT analysis_id, 'extracted_audio_track', 'extracted_audio_track' FROM m WHERE media_type = 'video' AND has_audio "
    "UNION ALL SELECT analysis_id, 'metadata_snapshot', 'metadata_snapshot' FROM m)"
)


@query("artifact_catalog", f"{_ARTIFACTS} SELECT * FROM art")
def artifact_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return grids.artifact_catalog(_media(spark, sf), PARAMS).select(
        "analysis_id", "artifact_id", "artifact_type"
    )


@query(
    "analyzer_artifacts",
    f"{_ARTIFACTS}, {_CATALOG_SQL} SELECT p.analyzer_id, a.artifact_type, count(*) AS n_rows, count(DISTINCT a.analysis_id || a.artifact_id) AS n_artifacts "
    "FROM plan p JOIN art a ON a.analysis_id = p.analysis_id WHERE p.applicable AND p.enabled GROUP BY ALL",
)
def analyzer_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    given = analyzers.request_artifacts(_media(spark, sf), _catalog(spark), PARAMS)
    return given.groupBy("analyzer_id", "artifact_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.concat("analysis_id", "artifact_id")).alias("n_artifacts")
    )


@query(
    "artifacts_left",
    f"{_ARTIFACTS} SELECT artifact_type, count(*) AS n_left FROM art WHERE artifact_type <> 'key_frame' GROUP BY artifact_type",
)
def artifacts_left(spark: SparkSession, sf: str) -> DataFrame:
    catalog = grids.artifact_catalog(_media(spark, sf), PARAMS)
    left = retention.outstanding(catalog, catalog.where("artifact_type = 'key_frame'"))
    return left.groupBy("artifact_type").agg(F.count("*").alias("n_left"))


@query(
    "stable_ids",
    "SELECT page_id, substr(sha256(url || chr(31) || page_id), 1, 32) AS analysis_id FROM pages",
)
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select(
        "page_id", X.stable_id(F.col("url"), F.col("page_id")).alias("analysis_id")
    )
