"""The ordered validation gate.

One boolean per check is evaluated on the row, and the position of the first failure cuts
the list of checks and picks the error. There is no shuffle and no Python in this module.

Input columns of `run_gate`:
  analysis_id, original_name, declared_content_type, size_bytes, sha256,
  header_kind, document_type, brands      -- from `signature.classify`
  probe_status ('ok', 'rejected', 'system_failure' or null), probe  -- from `probe.flatten`
  read_status  ('ok', 'rejected', 'system_failure' or null), image  -- decoder metadata
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions import probe as P
from mediasift.functions import text as X
from mediasift.functions.base import built_once, let, text_array, with_fields_of
from mediasift.functions.errors import error_record
from mediasift.params import Params

_AT = {code: i + 1 for i, code in enumerate(vocab.CHECKS)}


def _known_facts() -> Column:
    """What the row says by itself: extension, declared type, state of the probe."""
    # a webm document is refused before a probe is asked for
    needs_probe = F.col("header_kind").isin(*vocab.PROBED_KINDS) & ~F.col(
        "document_type"
    ).eqNullSafe(F.lit("webm"))
    probed = F.coalesce(F.col("probe_status"), F.lit("system_failure"))
    malformed = (probed == "ok") & F.col("probe").isNull()
    detected = F.when(
        ~needs_probe | (probed == "ok"),
        P.resolved_extension(F.col("header_kind"), F.col("brands"), F.col("probe")),
    )
    yes = F.lit(True)
    return F.struct(
        X.file_extension(F.col("original_name")).alias("extension"),
        X.normalized_mime(F.col("declared_content_type")).alias("declared_mime"),
        F.coalesce(needs_probe & ((probed == "system_failure") | malformed), ~yes).alias(
            "probe_failed"
        ),
        F.coalesce(needs_probe & (probed == "rejected"), ~yes).alias("probe_rejected"),
        F.when(~F.col("document_type").eqNullSafe(F.lit("webm")), detected).alias(
            "detected_extension"
        ),
    )


def _looked_up(known: Column) -> Column:
    """Adds what the format matrix says about both extensions."""
    return F.struct(
        known["extension"].alias("extension"),
        known["declared_mime"].alias("declared_mime"),
        known["probe_failed"].alias("probe_failed"),
        known["probe_rejected"].alias("probe_rejected"),
        known["detected_extension"].alias("detected_extension"),
        P.format_field(known["extension"], "mime").alias("expected_mime"),
        P.format_field(known["detected_extension"], "mime").alias("detected_mime"),
        P.format_field(known["detected_extension"], "media_type").alias("media_type"),
        P.format_field(known["detected_extension"], "container").alias("container"),
    )


_FACTS = (
    "extension",
    "declared_mime",
    "probe_failed",
    "probe_rejected",
    "detected_extension",
    "expected_mime",
    "detected_mime",
    "media_type",
    "container",
)


def _measured(f: Column, params: Params) -> Column:
    """Adds the size limit and the technical parameters of the detected media type."""
    kind, probe = f["media_type"], F.col("probe")
    return F.struct(
        *[f[n].alias(n) for n in _FACTS],
        P.size_limit_bytes(kind, params).alias("limit_bytes"),
        F.when(kind == "image", F.col("image")).cast(schemas.IMAGE).alias("image_parameters"),
        F.when(kind == "audio", P.audio_parameters(probe)).cast(schemas.AUDIO).alias(
            "audio_parameters"
        ),
        F.when(kind == "video", P.video_parameters(probe, f["container"]))
        .cast(schemas.VIDEO)
        .alias("video_parameters"),
    )


def _passes(f: Column) -> dict[str, Column]:
    """One predicate per check; null counts as a failure."""
    undeclared = F.col("declared_content_type").isNull()
    parameters = (
        f["image_parameters"].isNotNull()
        | f["audio_parameters"].isNotNull()
        | f["video_parameters"].isNotNull()
    )
    yes = F.lit(True)
    return {
        "file_not_empty": F.col("size_bytes") > 0,
        "extension_present": f["extension"].isNotNull(),
        "extension_allowed": f["expected_mime"].isNotNull(),
        "file_signature_valid": f["detected_extension"].isNotNull()
        & ~f["probe_failed"]
        & ~f["probe_rejected"],
        "detected_mime_allowed": yes,
        "media_type_supported": yes,
        "type_consistent": f["expected_mime"] == f["detected_mime"],
        "declared_mime_consistent": undeclared | f["declared_mime"].eqNullSafe(f["detected_mime"]),
        "file_size_allowed": F.col("size_bytes") <= f["limit_bytes"],
        "safe_read_completed": (F.col("read_status") == "ok") & parameters,
        "technical_parameters_available": yes,
        "sha256_available": yes,
    }


def _error_code(f: Column, failed_at: Column) -> Column:
    code = {
        "file_not_empty": F.lit("file_empty"),
        "extension_present": F.lit("missing_extension"),
        "extension_allowed": F.lit("unsupported_extension"),
        "file_signature_valid": F.when(
            f["probe_rejected"], F.lit("unsafe_or_unreadable_file")
        ).otherwise(F.lit("unsupported_mime_type")),
        "type_consistent": F.lit("file_signature_mismatch"),
        "declared_mime_consistent": F.lit("file_signature_mismatch"),
        "file_size_allowed": F.lit("file_too_large"),
        "safe_read_completed": F.lit("unsafe_or_unreadable_file"),
    }
    out: Column | None = None
    for check, value in code.items():
        hit = failed_at == _AT[check]
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _judged(f: Column, params: Params) -> Column:
    flags = _passes(f)
    results = F.array(*[F.coalesce(flags[c], F.lit(False)) for c in vocab.CHECKS])
    broken = ~(F.coalesce(F.col("size_bytes") >= 0, F.lit(False)) & X.is_sha256(F.col("sha256")))
    over = F.coalesce(F.col("size_bytes") > params.hard_limit_bytes, F.lit(False))

    def verdict(failed_at: Column) -> Column:
        unreadable = F.coalesce(F.col("read_status"), F.lit("system_failure")) == "system_failure"
        our_fault = (
            broken
            | ((failed_at == _AT["file_signature_valid"]) & f["probe_failed"])
            | ((failed_at == _AT["safe_read_completed"]) & unreadable)
        )
        status = (
            F.when(over, "rejected")
            .when(our_fault, "failed")
            .when(failed_at == 0, "accepted")
            .otherwise("rejected")
        )
        return F.struct(
            failed_at.alias("failed_at"), over.alias("over_hard_limit"), status.alias("status")
        )

    def with_error(v: Column) -> Column:
        rejected = v["status"] == "rejected"
        names = text_array(vocab.CHECKS)
        return F.struct(
            *[f[n].alias(n) for n in _FACTS],
            *[
                f[n].alias(n)
                for n in ("limit_bytes", "image_parameters", "audio_parameters", "video_parameters")
            ],
            v["failed_at"].alias("failed_at"),
            v["over_hard_limit"].alias("over_hard_limit"),
            v["status"].alias("status"),
            F.when(
                rejected & ~v["over_hard_limit"], F.try_element_at(names, v["failed_at"])
            ).alias("failed_check"),
            F.when(v["over_hard_limit"], "file_too_large")
            .when(v["status"] == "failed", "internal_error")
            .when(rejected, _error_code(f, v["failed_at"]))
            .alias("error_code"),
        )

    at = F.array_position(results, F.lit(False)).cast("int")
    return let(at, lambda n: let(verdict(n), with_error))


def with_verdict(df: DataFrame, params: Params) -> DataFrame:
    """Adds the facts and status, failed_at, failed_check, error_code.

    status is 'accepted', 'rejected' (the input is at fault) or 'failed' (we are). A file over
    the largest limit is rejected before any check, so it has no check list.

    The verdict is one nested expression, in which each intermediate value is named once.
    """
    return with_fields_of(df, _verdict(params))


@built_once
def _verdict(params: Params) -> Column:
    return let(
        let(_known_facts(), _looked_up),
        lambda f: let(_measured(f, params), lambda m: _judged(m, params)),
    )


def _details(code: Column, limit: Column) -> Column:
    """Safe details: the detected MIME of a mismatch, both sizes of an oversized file."""
    return F.struct(
        F.when(code == "file_signature_mismatch", F.col("detected_mime")).alias(
            "detected_mime_type"
        ),
        F.when(code == "file_too_large", limit).alias("max_size_bytes"),
        F.when(code == "file_too_large", F.col("size_bytes")).alias("observed_size_bytes"),
    )


def with_records(df: DataFrame, params: Params) -> DataFrame:
    """Adds the nested `validation` and `validated_file` records and `errors`."""
    validated = ~F.col("over_hard_limit") & (F.col("status") != "failed")
    reached = F.when(F.col("failed_at") == 0, len(vocab.CHECKS)).otherwise(F.col("failed_at"))
    names = F.slice(text_array(vocab.CHECKS), F.lit(1), reached)
    listed = F.filter(
        names,
        lambda c: (c != "declared_mime_consistent") | F.col("declared_content_type").isNotNull(),
    )
    checks = F.transform(
        listed,
        lambda c: F.struct(
            c.alias("code"),
            (~c.eqNullSafe(F.col("failed_check"))).alias("passed"),
            F.concat(
                F.replace(c, F.lit("_"), F.lit(" ")),
                F.when(c.eqNullSafe(F.col("failed_check")), ": failed").otherwise(": passed"),
            ).alias("message"),
        ),
    )
    limit = F.when(F.col("over_hard_limit"), F.lit(params.hard_limit_bytes)).otherwise(
        F.col("limit_bytes")
    )
    system = F.col("error_code") == "internal_error"
    error = let(
        F.struct(F.col("error_code").alias("code"), _details(F.col("error_code"), limit).alias("d")),
        lambda e: F.when(system, error_record(e["code"], details=e["d"])).otherwise(
            error_record(e["code"], details=e["d"], field="file")
        ),
    )
    descriptor = F.struct(
        F.col("original_name"),
        F.col("extension"),
        F.col("declared_mime").alias("declared_mime_type"),
        F.col("detected_mime").alias("detected_mime_type"),
        F.col("media_type"),
        F.col("size_bytes"),
        F.col("sha256"),
        F.lit(True).alias("signature_match"),
        F.lit(True).alias("safe_read"),
        F.struct(
            F.col("image_parameters").alias("image"),
            F.col("audio_parameters").alias("audio"),
            F.col("video_parameters").alias("video"),
        ).alias("technical_parameters"),
    )
    none = F.array().cast(f"array<{schemas.ERROR}>")
    accepted = F.col("status") == "accepted"
    df = df.withColumns(
        {
            "validated_file": F.when(accepted, descriptor),
            "errors": F.when(F.col("error_code").isNotNull(), F.array(error)).otherwise(none),
        }
    )
    return df.withColumn(
        "validation",
        F.when(
            validated,
            F.struct(
                accepted.alias("accepted"),
                checks.alias("checks"),
                F.col("errors").alias("errors"),
                F.col("validated_file").alias("validated_file"),
            ),
        ),
    )


def run_gate(df: DataFrame, params: Params | None = None) -> DataFrame:
    """Verdict columns only: the cheap form for reports."""
    params = params or Params()
    return with_verdict(df, params)


def validate(df: DataFrame, params: Params | None = None) -> DataFrame:
    """Verdict and nested records."""
    params = params or Params()
    return with_records(run_gate(df, params), params)


def with_terminal_fields(outcomes: DataFrame) -> DataFrame:
    """Accepted and terminal outcomes in one table and one pass.

    Terminal rows get the fixed fields of an outcome before analysis; accepted rows get nulls.
    """
    ended = F.col("status") != "accepted"
    return outcomes.withColumns(
        {
            "stage": F.when(ended, "finished"),
            "completeness_status": F.when(ended, "not_assessed"),
            "final_risk_level": F.lit(None).cast("string"),
            "recommendation": F.lit(None).cast("string"),
            "n_analyzers": F.when(ended, 0),
            "n_findings": F.when(ended, 0),
        }
    )


def accepted(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'accepted'")


def terminal(outcomes: DataFrame) -> DataFrame:
    """Rejected and failed rows with the fixed fields of a terminal outcome."""
    return with_terminal_fields(outcomes).where("status <> 'accepted'")


def outcome_union(accepted_rows: DataFrame, terminal_rows: DataFrame) -> DataFrame:
    """Separately stored accepted and terminal outcomes as one table."""
    return accepted_rows.unionByName(terminal_rows, allowMissingColumns=True)


def accepted_is_consistent(validation: Column, validated_file: Column) -> Column:
    """The stored descriptor equals the one of its validation."""
    return (
        validation["accepted"]
        & validated_file.isNotNull()
        & validation["validated_file"].eqNullSafe(validated_file)
    )


def execution_is_consistent(status: Column, error_count: Column) -> Column:
    """Completed has no errors, failed has one at least, nothing else is allowed (C17)."""
    return (
        F.when(status == "completed", error_count == 0)
        .when(status == "failed", error_count > 0)
        .otherwise(F.lit(False))
    )


def terminal_is_consistent(
    status: Column, error_count: Column, validation: Column, validated_file: Column
) -> Column:
    """Cross-field rules of a terminal intake row."""
    by_validation = (
        F.when(validation.isNull(), validated_file.isNull())
        .when(~validation["accepted"], (status == "rejected") & validated_file.isNull())
        .otherwise(
            (status == "failed")
            & validated_file.isNotNull()
            & validation["validated_file"].eqNullSafe(validated_file)
        )
    )
    return status.isin("rejected", "failed") & (error_count > 0) & by_validation
