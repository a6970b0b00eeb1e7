"""Completeness, risk and recommendation (F07-F15, F17, H04) and the result document.

The weights, thresholds and actions are provisional policy, not validated science: every
output names the policy and its version, and `probability` stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators import rules as R
from mediasift.params import Params
from mediasift.sources import dims


#: Analyses that ended so had nothing to assess if no analyzer ran.
_ENDED_EARLY = ("rejected", "failed")


def completeness(
    analyzer_rows: DataFrame, params: Params | None = None, *, analyses: DataFrame | None = None
) -> DataFrame:
    """Counters, coverage ratio and status per analysis.

    `applicable` comes from its own column, never from the status. Coverage is the plain share of
    applicable analyzers that completed. With `analyses` (analysis_id, status: one row each) those
    without an analyzer row are there too, with zeros: `not_assessed` if they were rejected or failed,
    `insufficient` otherwise.
    """
    params = params or Params()
    status = F.col("status")
    counted = analyzer_rows.groupBy("analysis_id").agg(
        F.count("*").alias("planned_analyzers"),
        F.count_if("applicable").alias("applicable_analyzers"),
        F.count_if(status == "completed").alias("completed_analyzers"),
        F.count_if(status == "error").alias("failed_analyzers"),
        F.count_if(status == "timeout").alias("timed_out_analyzers"),
        F.count_if(status == "skipped").alias("skipped_analyzers"),
        F.count_if(status == "not_applicable").alias("not_applicable_analyzers"),
        F.count_if(F.col("applicable") & (status == "completed")).alias("_covered"),
    )
    early = F.lit(False)
    if analyses is not None:
        ended = analyses.select("analysis_id", F.col("status").isin(*_ENDED_EARLY).alias("_early"))
        counters = [c for c in counted.columns if c != "analysis_id"]
        counted = ended.join(counted, "analysis_id", "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in counters}
        )
        early = F.coalesce("_early", F.lit(False)) & (F.col("planned_analyzers") == 0)
    ratio = F.coalesce(
        F.try_divide(F.col("_covered").cast("double"), F.col("applicable_analyzers").cast("double")),
        F.lit(0.0),
    )
    return (
        counted.withColumn("coverage_ratio", ratio)
        .withColumn(
            "completeness_status",
            F.when(early, "not_assessed").otherwise(
                completeness_status(F.col("coverage_ratio"), F.col("applicable_analyzers"), params)
            ),
        )
        .drop("_covered", "_early")
    )


def completeness_status(ratio: Column, applicable: Column, params: Params) -> Column:
    return (
        F.when(applicable == 0, "insufficient")
        .when(ratio >= 1.0, "complete")
        .when(ratio >= params.minimum_coverage, "partial")
        .otherwise("insufficient")
    )


def severity_weight(severity: Column, params: Params) -> Column:
    """Score of one finding; critical findings act through the override, not the sum."""
    return (
        F.when(severity == "weak", params.weak_score)
        .when(severity == "significant", params.significant_score)
        .otherwise(0)
    )


def risk_scores(findings: DataFrame, params: Params | None = None) -> DataFrame:
    """Score per analysis, each correlation group counted once by its strongest finding (F10),
    with the override evidence (F12).

    A finding without a group is a group of its own, under its id, so a finding that arrives twice
    counts once; a group that happens to bear that id is another one. Groups of one analysis spread over all tasks; the sum per analysis combines
    before its shuffle.
    """
    params = params or Params()
    weight = severity_weight(F.col("severity"), params)
    eligible = (
        F.col("critical_override_eligible")
        & (F.col("severity") == "critical")
        & F.col("type").isin(*params.override_finding_types)
        if params.override_enabled and params.override_finding_types
        else F.lit(False)
    )
    alone = F.when(F.col("correlation_group").isNull(), F.col("finding_id")).alias("_alone")
    by_group = findings.groupBy("analysis_id", "correlation_group", alone).agg(
        F.max(weight).alias("weight"),
        F.count("*").alias("n"),
        F.count_if(eligible).alias("critical"),
        F.min(F.when(eligible, F.col("finding_id"))).alias("first_critical"),
    )
    return by_group.groupBy("analysis_id").agg(
        F.sum("weight").cast("double").alias("score"),
        F.sum("n").alias("n_findings"),
        F.sum("critical").alias("n_override_findings"),
        F.min("first_critical").alias("first_override_finding"),
    )


def override_findings(findings: DataFrame, params: Params) -> DataFrame:
    """Every finding that justifies an override, in long form."""
    if not (params.override_enabled and params.override_finding_types):
        return findings.select("analysis_id", "finding_id").where(F.lit(False))
    return findings.where(
        F.col("critical_override_eligible")
        & (F.col("severity") == "critical")
        & F.col("type").isin(*params.override_finding_types)
    ).select("analysis_id", "finding_id")


def level_of(score: Column, params: Params) -> Column:
    """low up to low_max, medium up to medium_max, high beyond."""
    return (
        F.when(score <= params.low_max, "low")
        .when(score <= params.medium_max, "medium")
        .when(score.isNotNull(), "high")
    )


def assess(
    completeness_rows: DataFrame, findings: DataFrame, params: Params | None = None
) -> DataFrame:
    """Levels per analysis (F10-F13): none at all where coverage is insufficient."""
    params = params or Params()
    scored = completeness_rows.join(risk_scores(findings, params), "analysis_id", "left")
    scored = scored.withColumns(
        {
            "score": F.coalesce("score", F.lit(0.0)),
            "n_findings": F.coalesce("n_findings", F.lit(0)),
            "n_override_findings": F.coalesce("n_override_findings", F.lit(0)),
        }
    )
    usable = F.col("completeness_status").isin("complete", "partial")
    applied = usable & (F.col("n_override_findings") > 0)
    base = F.when(usable, level_of(F.col("score"), params))
    return scored.withColumns(
        {
            "score_based_level": base,
            "critical_override_applied": applied,
            "final_level": F.when(applied, "high").otherwise(base),
            "probability": F.lit(None).cast("double"),
            "policy_id": F.lit(params.policy_id),
            "policy_version": F.lit(params.policy_version),
        }
    )


def recommend(assessed: DataFrame) -> DataFrame:
    """Action by completeness and level from the versioned policy table."""
    policy = F.broadcast(dims.recommendation_policy(assessed.sparkSession))
    keyed = assessed.withColumn("level_key", F.coalesce("final_level", F.lit("none")))
    return keyed.join(policy, ["completeness_status", "level_key"], "left").drop("level_key")


def duration_ms(started_at: Column, finished_at: Column) -> Column:
    """Whole milliseconds between two times."""
    return F.timestamp_diff("MILLISECOND", started_at, finished_at)


def result_status(outcome: Column, completeness_of: Column) -> Column:
    """Final status from the gate outcome and the coverage.

    An applicable analyzer that failed lowers the coverage, so it makes the result partial.
    Without a usable level a result can be neither completed nor partial.
    """
    return (
        F.when(outcome == "rejected", "rejected")
        .when(outcome == "failed", "failed")
        .when(completeness_of == "complete", "completed")
        .when(completeness_of == "partial", "partial")
        .otherwise("failed")
    )


def missing_capabilities(catalog: DataFrame, analyzer_rows: DataFrame) -> DataFrame:
    """Required capabilities an analysis did not complete (H04): analysis_id, capability.

    catalog: analyzer_id, capability, required. A capability counts as completed when any of its
    analyzers completed.
    """
    required = dims.broadcast_if_small(
        catalog.where("required").select("analyzer_id", "capability").distinct()
    )
    per = analyzer_rows.join(required, "analyzer_id").groupBy("analysis_id", "capability").agg(
        F.bool_or(F.col("status") == "completed").alias("done")
    )
    return per.where(~F.col("done")).select("analysis_id", "capability")


def risk_record(assessed: DataFrame) -> DataFrame:
    """Adds the nested `completeness`, `risk_assessment` and `recommendation` records.

    Needs the columns of `recommend`. The list of critical ids is left to `assemble`.
    """
    none = F.array().cast("array<string>")
    level = F.coalesce("final_level", F.lit("not available"))
    c = F.col
    return assessed.withColumns(
        {
            "completeness": F.struct(
                c("completeness_status").alias("status"),
                *[
                    c(f"{n}_analyzers").cast("int").alias(f"{n}_analyzers")
                    for n in (
                        "planned",
                        "applicable",
                        "completed",
                        "failed",
                        "timed_out",
                        "skipped",
                        "not_applicable",
                    )
                ],
                c("coverage_ratio"),
                none.alias("missing_capabilities"),
                F.format_string(
                    "%d of %d applicable analyzers completed.",
                    F.round(c("coverage_ratio") * c("applicable_analyzers")).cast("int"),
                    c("applicable_analyzers").cast("int"),
                ).alias("explanation"),
            ),
            "risk_assessment": F.struct(
                c("policy_id").alias("model_id"),
                c("policy_version").alias("model_version"),
                c("score"),
                c("score_based_level"),
                c("critical_override_applied"),
                none.alias("critical_finding_ids"),
                c("final_level"),
                c("probability"),
                F.lit(None).cast("string").alias("probability_method"),
                F.concat(F.lit("Risk indication: "), level).alias("summary"),
                F.lit("Provisional weights; an indication, not proof.").alias("explanation"),
                none.alias("limitations"),
            ),
            "recommendation": F.struct(
                c("primary_action"),
                none.alias("additional_actions"),
                F.replace("primary_action", F.lit("_"), F.lit(" ")).alias("text"),
                c("requires_manual_review"),
            ),
        }
    )


_KEEP_NULLS = {"ignoreNullFields": "false"}


def _children(analyzer_rows: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """analysis_id, section, child_id, critical and JSON of every analyzer, and of every finding."""
    critical = F.col("_critical") if "_critical" in findings.columns else F.lit(False)

    def children(rows: DataFrame, section: str, child_id: str, is_critical: Column) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("analysis_id", "_critical")]
        return rows.select(
            "analysis_id",
            F.lit(section).alias("section"),
            F.col(child_id).alias("child_id"),
            is_critical.alias("critical"),
            F.to_json(F.struct(*fields), _KEEP_NULLS).alias("json"),
        )

    return (
        children(analyzer_rows, "analyzers", "analyzer_id", F.lit(False)),
        children(findings, "findings", "finding_id", critical),
    )


def document_rows(heads: DataFrame, analyzer_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Result documents in long form: one `head` row per analysis, one row per analyzer and finding.

    Columns: analysis_id, section, child_id, critical, json. Nothing is gathered, so that analyses of
    any size have the same form; ids that an override rests on are the rows marked critical, and
    children are in order by section and child_id.
    """
    fields = [c for c in heads.columns if c != "first_override_finding"]
    head = heads.select(
        "analysis_id",
        F.lit("head").alias("section"),
        F.lit(None).cast("string").alias("child_id"),
        F.lit(False).alias("critical"),
        F.to_json(F.struct(*fields), _KEEP_NULLS).alias("json"),
    )
    analyzers, found = _children(analyzer_rows, findings)
    return head.unionByName(analyzers).unionByName(found)


def assemble(heads: DataFrame, analyzer_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Result documents as JSON text: analysis_id, n_analyzers, n_findings, doc.

    heads: one row per analysis with every other field of the document, `risk_assessment` among
    them. analyzer_rows and findings: the fields of the nested records, plus analysis_id; findings
    may have a boolean `_critical` that marks override evidence.

    Always one document per analysis, as it is one file; it holds all of its children, sorted by id, and
    thus has to fit a row. `document_rows` is the form for analyses that may not. Empty lists are kept.
    """

    def gathered(rows: DataFrame, section: str) -> DataFrame:
        picked = F.transform(F.sort_array(F.collect_list(F.struct("child_id", "json"))), lambda x: x["json"])
        ids = F.sort_array(F.collect_list(F.when(F.col("critical"), F.col("child_id"))))
        return rows.groupBy("analysis_id").agg(picked.alias(section), *([ids.alias("critical_ids")] if section == "findings" else []))

    lists = [gathered(rows, section) for rows, section in zip(_children(analyzer_rows, findings), ("analyzers", "findings"), strict=True)]
    none = F.array().cast("array<string>")
    first = (
        F.array_compact(F.array("first_override_finding"))
        if "first_override_finding" in heads.columns
        else none
    )
    ids = F.when(F.size(F.coalesce("critical_ids", none)) > 0, F.col("critical_ids")).otherwise(first)
    risk = F.col("risk_assessment").withField("critical_finding_ids", ids).alias("risk_assessment")
    fields = [c for c in heads.columns if c != "first_override_finding"]
    # the lists come where the data model has them
    order = list(R.SHAPES["result"])
    behind = [c for c in fields if c in order[order.index("findings") :]]

    def members(names: list[str]) -> list[Column]:
        text = F.to_json(F.struct(*[risk if c == "risk_assessment" else c for c in names]), _KEEP_NULLS)
        inner = F.substring(text.cast("binary"), F.lit(2), F.octet_length(text) - 2)  # bytes are cut without being counted
        return [inner.cast("string")] if names else []

    def as_list(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":['), F.array_join(F.coalesce(F.col(name), none), ","), F.lit("]"))

    parts = [*members([c for c in fields if c not in behind]), as_list("analyzers"), as_list("findings"), *members(behind)]
    doc = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return heads.join(lists[0], "analysis_id", "left").join(lists[1], "analysis_id", "left").select(
        "analysis_id",
        F.size(F.coalesce("analyzers", none)).alias("n_analyzers"),
        F.size(F.coalesce("findings", none)).alias("n_findings"),
        doc.alias("doc"),
    )
