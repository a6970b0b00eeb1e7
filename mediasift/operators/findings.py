"""Nested arrays to rows, localization decoding, finding formation and reference checks
(J01-J06, F16, E09, E10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift import schemas
from mediasift.functions import jsontypes as J
from mediasift.functions.base import let


def flatten_array(results: DataFrame, array: str, *, keep_empty: bool = False) -> DataFrame:
    """One row per element of a nested array of `result`, with its position."""
    r = F.col("result")
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return results.select(
        r["analysis_id"].alias("analysis_id"), explode(r[array]).alias("pos", "item")
    ).select("analysis_id", "pos", "item.*")


_PLACE_FIELDS = {
    "bounding_box": ("x", "y", "width", "height", "coordinate_space"),
    "time_interval": ("start_seconds", "end_seconds"),
    "frame_interval": ("start_frame", "end_frame"),
}


def decode_localization(value: Column) -> Column:
    """Tagged union as one wide struct.

    The object is read once as the union of all fields. Fields of another kind are kept, so that
    the closed-shape rule R16 can see them; an object without a known type gives null.
    """
    return let(
        F.try_variant_get(value, "$", schemas.LOCALIZATION),
        lambda p: F.when(p["type"].isNotNull(), p),
    )


def own_fields(place: Column) -> Column:
    """The same localization with the fields of other kinds set to null."""
    return F.struct(
        place["type"].alias("type"),
        *[
            F.when(place["type"] == kind, place[name]).alias(name)
            for kind, names in _PLACE_FIELDS.items()
            for name in names
        ],
    ).cast(schemas.LOCALIZATION)


def file_kind(file: Column) -> Column:
    """'validated' or 'input' by the keys a JSON `file` object has."""
    return F.when(F.array_contains(J.object_keys(file), "sha256"), "validated").otherwise("input")


def form_findings(analyzer_rows: DataFrame) -> DataFrame:
    """Candidate findings of each analyzer row as normalized rows (F16).

    Candidates are JSON texts; every finding keeps the id and version of its analyzer. The id of a
    finding is derived from its origin, so a recomputed row keeps it.
    """
    candidate = F.try_parse_json("candidate")

    def text(name: str) -> Column:
        return F.try_variant_get(candidate, f"$.{name}", "string")

    def number(name: str) -> Column:
        return F.try_variant_get(candidate, f"$.{name}", "double")

    exploded = analyzer_rows.select(
        "analysis_id",
        "analyzer_id",
        "analyzer_version",
        "group",
        "score",
        F.posexplode("candidate_findings").alias("pos", "candidate"),
    )
    return exploded.select(
        "analysis_id",
        F.concat_ws("-", "analyzer_id", "pos").alias("finding_id"),
        "group",
        text("type").alias("type"),
        text("severity").alias("severity"),
        F.col("analyzer_id").alias("source_analyzer_id"),
        F.col("analyzer_version").alias("source_analyzer_version"),
        F.coalesce(text("description"), F.lit("")).alias("description"),
        decode_localization(J.member(candidate, "localization")).alias("localization"),
        F.col("score").alias("source_score"),
        number("score_impact").alias("score_impact"),
        F.coalesce(
            F.try_variant_get(candidate, "$.critical_override_eligible", "boolean"), F.lit(False)
        ).alias("critical_override_eligible"),
        text("correlation_group").alias("correlation_group"),
        F.coalesce(
            F.try_variant_get(candidate, "$.evidence_refs", "array<string>"),
            F.array().cast("array<string>"),
        ).alias("evidence_refs"),
    )


def orphan_sources(findings: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Analyzer references of findings that match no analyzer row of the analysis.

    Findings are counted per reference first, so a dominant reference is one row in the join.
    """
    key = ["analysis_id", "source_analyzer_id", "source_analyzer_version"]
    referenced = findings.groupBy(*key).agg(F.count("*").alias("n_findings"))
    present = analyzers.select(
        "analysis_id",
        F.col("analyzer_id").alias("source_analyzer_id"),
        F.col("analyzer_version").alias("source_analyzer_version"),
    ).distinct()
    return referenced.join(present, key, "left_anti")


def dangling_critical_ids(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """Critical ids of an assessment that name no finding."""
    named = assessments.select("analysis_id", F.explode("critical_finding_ids").alias("finding_id"))
    return named.join(
        findings.select("analysis_id", "finding_id"), ["analysis_id", "finding_id"], "left_anti"
    )
