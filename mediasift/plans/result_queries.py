"""Queries over stored results and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.functions import jsontypes as J
from mediasift.functions import text as X
from mediasift.operators import findings
from mediasift.operators import rules as R
from mediasift.plans.registry import query
from mediasift.plans.views import cte, read, view
from mediasift.sources import results, store
from mediasift.sources.shared import new_folder

# --- stored results ------------------------------------------------------------------------------
def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "result_v").select(
        "analysis_id",
        "created_at",
        "status",
        F.when(F.col("validated"), F.col("media_type")).alias("media_type"),
        F.col("level").alias("final_risk_level"),
        F.col("completeness").alias("completeness_status"),
    )


_SUMMARY = (
    "analysis_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, status, "
    "CASE WHEN validated THEN media_type END AS media_type, level AS final_risk_level, completeness AS completeness_status"
)


@query(
    "results_recent",
    f"{cte('result_v')} SELECT analysis_id, created, status FROM (SELECT analysis_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created, status, "
    "created_at FROM result_v ORDER BY created_at DESC, analysis_id LIMIT 100)",
)
def results_recent(spark: SparkSession, sf: str) -> DataFrame:
    return results.recent(_summaries(spark, sf), 100).select(
        "analysis_id", X.iso_utc(F.col("created_at")).alias("created"), "status"
    )


@query("results_summary", f"{cte('result_v')} SELECT {_SUMMARY} FROM result_v")
def results_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).withColumn("created_at", X.iso_utc(F.col("created_at")))


@query(
    "results_latest",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props "
    "FROM events GROUP BY user_id",
)
def results_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    return results.latest_per_id(rows, "user_id", "event_id").select(
        "user_id", "event_id", "event_type", "props"
    )


@query(
    "results_upsert",
    "WITH incoming AS (SELECT l_orderkey AS k, arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_linenumber)) AS status "
    "FROM lineitem WHERE l_quantity >= 10 GROUP BY l_orderkey) "
    "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT k FROM incoming) "
    "UNION ALL SELECT k, status FROM incoming",
)
def results_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")
    )
    incoming = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_returnflag").alias("status"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("written"),
        "l_quantity",
    )
    return results.upsert(stored, incoming, "k", "written", valid=F.col("l_quantity") >= 10)


@query(
    "results_exists",
    "SELECT DISTINCT l_orderkey AS analysis_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def results_exists(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id")).distinct()
    stored = read(spark, sf, "orders").where("o_orderstatus = 'F'")
    return results.existing(ids, stored.select(F.col("o_orderkey").alias("analysis_id")))


_BUCKETS = 64
_LATE_LINES = "l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 3 DAY FROM lineitem)"


def _order_store(spark: SparkSession, sf: str) -> store.Snapshot:
    """All orders, then the newest lines of their last three days written over them."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("status"))
    lines = read(spark, sf, "lineitem")
    newest = lines.agg(F.max("l_shipdate").alias("newest"))
    recent = lines.join(newest, F.col("l_shipdate") >= F.col("newest") - F.expr("INTERVAL 3 DAY"))
    incoming = recent.select(
        F.col("l_orderkey").cast("string").alias("k"),
        F.col("l_returnflag").alias("status"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("written"),
        "l_quantity",
    )
    made = store.create(orders, new_folder(spark, "orders"), "k", _BUCKETS)
    return store.upsert(made, incoming, "k", "written", valid=F.col("l_quantity") >= 10)


_ORDER_STORE = (
    "WITH incoming AS (SELECT l_orderkey AS k, arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_linenumber)) AS status "
    f"FROM lineitem WHERE l_quantity >= 10 AND {_LATE_LINES} GROUP BY l_orderkey), "
    "stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT k FROM incoming) "
    "UNION ALL SELECT CAST(k AS VARCHAR), status FROM incoming)"
)


@query("store_upsert", f"{_ORDER_STORE} SELECT k, status FROM stored")
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _order_store(spark, sf).table()


@query(
    "store_exists",
    f"{_ORDER_STORE}, asked AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS k FROM lineitem) SELECT k FROM asked WHERE k IN (SELECT k FROM stored)",
)
def store_exists(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("k")).distinct()
    return _order_store(spark, sf).existing(asked, "k")


# --- integrity rules -----------------------------------------------------------------------------
def _listing(parts: list[tuple[str, str]]) -> str:
    """Comma-separated names of the SQL conditions that are violated, in order."""
    arms = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in parts)
    return f"concat_ws(',', {arms})"


_TERMINAL = _listing(
    [
        ("R20", "status = 'completed' AND NOT (validated AND completeness = 'complete' AND level IS NOT NULL)"),
        ("R21", "status = 'partial' AND NOT (validated AND completeness = 'partial' AND level IS NOT NULL)"),
        ("R22", "status = 'partial' AND NOT explained"),
        (
            "R23",
            "status = 'rejected' AND NOT (n_analyzers = 0 AND n_findings = 0 AND level IS NULL "
            "AND completeness = 'not_assessed' AND n_errors > 0)",
        ),
        ("R24", "status = 'failed' AND NOT (level IS NULL AND n_errors > 0)"),
        ("R25", "completeness = 'insufficient' AND level IS NOT NULL"),
    ]
)


@query("rules_result", f"{cte('result_v')} SELECT o_orderkey, {_TERMINAL} AS violations FROM result_v")
def rules_result(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rules = R.terminal_rules(
        status=c("status"),
        validated=c("validated"),
        completeness=c("completeness"),
        level=c("level"),
        n_analyzers=c("n_analyzers"),
        n_findings=c("n_findings"),
        n_errors=c("n_errors"),
        limitation_explained=c("explained"),
    )
    return R.with_violations(view(spark, sf, "result_v"), rules).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations")
    )


@query(
    "rules_result_counts",
    f"{cte('result_v')}, broken AS (SELECT unnest(string_split({_TERMINAL}, ',')) AS rule FROM result_v) "
    "SELECT rule, count(*) AS n_rows FROM broken WHERE rule <> '' GROUP BY rule",
)
def rules_result_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rules = R.terminal_rules(
        status=c("status"), validated=c("validated"), completeness=c("completeness"), level=c("level"),
        n_analyzers=c("n_analyzers"), n_findings=c("n_findings"), n_errors=c("n_errors"),
        limitation_explained=c("explained"),
    )
    return R.violation_counts(R.with_violations(view(spark, sf, "result_v"), rules))


@query(
    "rules_analyzer",
    f"{cte('analyzer_v')} SELECT event_id, "
    + _listing(
        [
            ("R08", "score_name IS NULL"),
            ("R09", "status = 'not_applicable' AND applicable"),
            ("R10", "status IN ('error', 'timeout') AND n_errors = 0"),
            ("R11", "status = 'skipped' AND trim(summary) = '' AND trim(warning) = ''"),
            ("R12", "run_ms < 0"),
        ]
    )
    + " AS violations FROM analyzer_v",
)
def rules_analyzer(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "analyzer_v").withColumns(
        {
            "score": F.col("value"),
            "duration_ms": F.col("run_ms"),
            "warnings": F.array("warning"),
            "errors": F.when(F.col("n_errors") > 0, F.array("event_id")).otherwise(
                F.array().cast("array<bigint>")
            ),
        }
    )
    return R.with_violations(runs, R.analyzer_rules(F.col)).select(
        "event_id", F.array_join("violations", ",").alias("violations")
    )


_PLACE = (
    f"{cte('place_v')}, p AS (SELECT row_id, kind, a, b, "
    "kind = 'bounding_box' AND (a >= 100 OR b IN (5, 6)) AS bad13, kind = 'time_interval' AND a > b AS bad14, "
    "kind = 'frame_interval' AND a > b AS bad15, kind = 'bounding_box' AND b = 5 AS bad16 FROM place_v)"
)


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "place_v").select(
        "row_id", findings.decode_localization(F.try_parse_json("place_json")).alias("place")
    )


@query(
    "rules_localization",
    f"{_PLACE} SELECT row_id, "
    + _listing([("R13", "bad13"), ("R14", "bad14"), ("R15", "bad15"), ("R16", "bad16 OR (kind = 'file' AND a = 7)")])
    + " AS violations FROM p",
)
def rules_localization(spark: SparkSession, sf: str) -> DataFrame:
    places = _places(spark, sf)
    rules = R.localization_rules(lambda n: F.col("place")[n])
    return R.with_violations(places, rules).select(
        "row_id", F.array_join("violations", ",").alias("violations")
    )


@query(
    "union_decode",
    f"{_PLACE} SELECT row_id, kind AS type, CAST(CASE WHEN kind = 'bounding_box' THEN CASE WHEN a >= 100 THEN 1.5 ELSE 0 END END AS DOUBLE) AS x, "
    "CAST(CASE WHEN kind = 'time_interval' THEN a END AS DOUBLE) AS start_seconds, "
    "CASE WHEN kind = 'frame_interval' THEN b END AS end_frame FROM p",
)
def union_decode(spark: SparkSession, sf: str) -> DataFrame:
    own = _places(spark, sf).select("row_id", findings.own_fields(F.col("place")).alias("place"))
    return own.select("row_id", "place.type", "place.x", "place.start_seconds", "place.end_frame")


@query(
    "json_keys",
    f"{_PLACE} SELECT row_id, "
    + _listing(
        [
            ("R03:file.x", "kind = 'file' AND a = 7"),
            ("R03:note", "a = b"),
            ("R04:bounding_box.coordinate_space", "kind = 'bounding_box' AND b = 5"),
        ]
    )
    + " AS violations FROM p",
)
def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    places = view(spark, sf, "place_v").withColumn("v", F.try_parse_json("place_json"))
    shape = F.when(F.lit(False), F.array().cast("array<string>"))
    for name in vocab.LOCALIZATION_TYPES:
        shape = shape.when(F.col("kind") == name, R.shape_violations(F.col("v"), name))
    plain = F.transform(shape, lambda v: F.regexp_replace(v, r"^R03:\w+\.note$", "R03:note"))
    return places.select("row_id", F.array_join(F.array_sort(plain), ",").alias("violations"))


@query(
    "null_vs_missing",
    f"{_PLACE} SELECT row_id, a = b AS is_null, a <> b AS is_missing FROM p",
)
def null_vs_missing(spark: SparkSession, sf: str) -> DataFrame:
    places = view(spark, sf, "place_v").withColumn("v", F.try_parse_json("place_json"))
    return places.select(
        "row_id",
        J.is_json_null(F.col("v"), "note").alias("is_null"),
        J.is_missing(F.col("v"), "note").alias("is_missing"),
    )


@query(
    "file_union_kind",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'input' ELSE 'validated' END AS kind, "
    "CASE WHEN doc_id % 3 <> 0 THEN lang END AS media_type FROM documents",
)
def file_union_kind(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 3 = 0 THEN '{\"size_bytes\":' || n_chars || '}' "
        "ELSE '{\"sha256\":\"' || sha2(text, 256) || '\",\"media_type\":\"' || lang || '\"}' END AS file_json",
    )
    tree = docs.withColumn("v", F.try_parse_json("file_json"))
    return tree.select(
        "doc_id",
        findings.file_kind(F.col("v")).alias("kind"),
        F.try_variant_get("v", "$.media_type", "string").alias("media_type"),
    )


@query(
    "json_passthrough",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, replace(props, ' ', '') AS props FROM events",
)
def json_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    tree = read(spark, sf, "events").withColumn("v", F.try_parse_json("props"))
    return tree.select(
        "event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.to_json("v").alias("props")
    )


@query(
    "finite_numbers",
    "SELECT event_id, event_id % 5 = 0 AS bad FROM events",
)
def finite_numbers(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "events").selectExpr(
        "event_id",
        "'{\"m\":[{\"v\":' || CASE event_id % 5 WHEN 0 THEN '-1e' || (400 + event_id) WHEN 1 THEN '1e300' "
        "WHEN 2 THEN '\"1e999\"' WHEN 3 THEN cast(event_id AS STRING) ELSE '\"q\\\\\"1e999\"' END || '}]}' AS doc",
    )
    return docs.select("event_id", X.has_non_finite_number(F.col("doc")).alias("bad"))


@query(
    "rules_risk",
    "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 END AS probability, "
    "CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'bayes' END AS method, o_custkey % 5 = 0 AS override, o_custkey % 2 AS n FROM orders) "
    "SELECT o_orderkey, "
    + _listing(
        [
            ("R18", "probability IS NOT NULL AND coalesce(trim(method), '') = ''"),
            ("R19", "override AND n = 0"),
        ]
    )
    + " AS violations FROM r",
)
def rules_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("score"),
        F.lit(None).cast("string").alias("score_based_level"),
        F.lit("low").alias("final_level"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.5)).alias("probability"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'bayes' END").alias("probability_method"),
        (F.col("o_custkey") % 5 == 0).alias("critical_override_applied"),
        F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit("f"))).otherwise(
            F.array().cast("array<string>")
        ).alias("critical_finding_ids"),
    )
    return R.with_violations(rows, R.risk_rules(F.col)).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations")
    )


@query(
    "rules_completeness",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 0 OR l_tax * 20 > 1 THEN 'R17' ELSE '' END AS violations FROM lineitem",
)
def rules_completeness(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0)
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.lit("complete").alias("status"),
        F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_partkey") % 2 == 0), -1).otherwise(1).alias("planned_analyzers"),
        *[zero.alias(f"{n}_analyzers") for n in ("applicable", "completed", "failed", "timed_out", "skipped", "not_applicable")],
        (F.col("l_tax") * 20).alias("coverage_ratio"),
    )
    return R.with_violations(rows, R.completeness_rules(F.col)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.array_join("violations", ",").alias("violations"),
    )
