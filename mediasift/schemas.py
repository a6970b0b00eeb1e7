"""Hand-written schemas: the data model is closed, nothing is inferred.

Timestamps of stored documents are read as strings and judged before they are cast
(a cast alone would silently shift other offsets to UTC).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = "string", "bigint", "double", "boolean"

ERROR = f"struct<code:{S},category:{S},message:{S},retryable:{B},field:{S},analyzer_id:{S},safe_details:variant>"
SOURCE = f"struct<channel:{S},connector:{S},external_system:{S},external_reference:{S}>"
IMAGE = f"struct<width:int,height:int,format:{S},color_mode:{S},frame_count:int,has_metadata:{B}>"
AUDIO = f"struct<duration_seconds:{D},sample_rate_hz:int,channels:int,codec:{S},bitrate_bps:{L}>"
VIDEO = (
    f"struct<duration_seconds:{D},container:{S},video_codec:{S},audio_codec:{S},width:int,"
    f"height:int,fps:{D},bitrate_bps:{L},has_audio:{B}>"
)
LOCALIZATION = (
    f"struct<type:{S},x:{D},y:{D},width:{D},height:{D},coordinate_space:{S},"
    f"start_seconds:{D},end_seconds:{D},start_frame:{L},end_frame:{L}>"
)
# the stored `file` is a union of two record kinds; technical parameters a union of three
STORED_PARAMETERS = (
    f"struct<width:int,height:int,format:{S},color_mode:{S},frame_count:int,has_metadata:{B},"
    f"duration_seconds:{D},sample_rate_hz:int,channels:int,codec:{S},bitrate_bps:{L},"
    f"container:{S},video_codec:{S},audio_codec:{S},fps:{D},has_audio:{B}>"
)
STORED_FILE = (
    f"struct<original_name:{S},declared_content_type:{S},size_bytes:{L},received_at:{S},"
    f"extension:{S},declared_mime_type:{S},detected_mime_type:{S},media_type:{S},sha256:{S},"
    f"signature_match:{B},safe_read:{B},technical_parameters:{STORED_PARAMETERS}>"
)
PROCESSING = (
    f"struct<queued_at:{S},started_at:{S},finished_at:{S},duration_ms:{L},"
    f"config_snapshot_id:{S},application_version:{S}>"
)
ANALYZER_RESULT = (
    f"struct<analyzer_id:{S},analyzer_version:{S},media_type:{S},group:{S},status:{S},"
    f"applicable:{B},started_at:{S},finished_at:{S},duration_ms:{L},score:{D},score_name:{S},"
    f"summary:{S},raw_metrics:variant,candidate_findings:array<variant>,warnings:array<{S}>,"
    f"errors:array<{ERROR}>>"
)
FINDING = (
    f"struct<finding_id:{S},group:{S},type:{S},severity:{S},source_analyzer_id:{S},"
    f"source_analyzer_version:{S},description:{S},localization:{LOCALIZATION},source_score:{D},"
    f"score_impact:{D},critical_override_eligible:{B},correlation_group:{S},"
    f"evidence_refs:array<{S}>>"
)
COMPLETENESS = (
    f"struct<status:{S},planned_analyzers:int,applicable_analyzers:int,completed_analyzers:int,"
    f"failed_analyzers:int,timed_out_analyzers:int,skipped_analyzers:int,"
    f"not_applicable_analyzers:int,coverage_ratio:{D},missing_capabilities:array<{S}>,"
    f"explanation:{S}>"
)
RISK = (
    f"struct<model_id:{S},model_version:{S},score:{D},score_based_level:{S},"
    f"critical_override_applied:{B},critical_finding_ids:array<{S}>,final_level:{S},"
    f"probability:{D},probability_method:{S},summary:{S},explanation:{S},limitations:array<{S}>>"
)
RECOMMENDATION = (
    f"struct<primary_action:{S},additional_actions:array<{S}>,text:{S},requires_manual_review:{B}>"
)
CLEANUP = (
    f"struct<status:{S},original_file_deleted:{B},intermediate_files_deleted:{B},"
    f"quarantine_used:{B},finished_at:{S},errors:array<{ERROR}>>"
)
RESULT = (
    f"struct<schema_version:{S},analysis_id:{S},created_at:{S},updated_at:{S},status:{S},stage:{S},"
    f"source:{SOURCE},file:{STORED_FILE},processing:{PROCESSING},"
    f"analyzers:array<{ANALYZER_RESULT}>,findings:array<{FINDING}>,completeness:{COMPLETENESS},"
    f"risk_assessment:{RISK},recommendation:{RECOMMENDATION},cleanup:{CLEANUP},"
    f"warnings:array<{S}>,errors:array<{ERROR}>>"
)

# the part of a result that a rule of `rules.result_rules` reads, or a caller counts
_JUDGED_ERRORS = f"array<struct<category:{S}>>"
JUDGED = (
    f"struct<schema_version:{S},analysis_id:{S},created_at:{S},updated_at:{S},status:{S},stage:{S},"
    f"source:struct<channel:{S}>,"
    f"file:struct<received_at:{S},media_type:{S},sha256:{S},technical_parameters:"
    f"struct<duration_seconds:{D},fps:{D},color_mode:{S},sample_rate_hz:int,video_codec:{S}>>,"
    f"processing:struct<queued_at:{S},started_at:{S},finished_at:{S},duration_ms:{L}>,"
    f"analyzers:array<struct<media_type:{S},status:{S},applicable:{B},started_at:{S},finished_at:{S},"
    f"duration_ms:{L},score:{D},score_name:{S},summary:{S},warnings:array<{S}>,errors:{_JUDGED_ERRORS}>>,"
    f"findings:array<struct<severity:{S},localization:{LOCALIZATION},source_score:{D},score_impact:{D}>>,"
    f"completeness:struct<status:{S},planned_analyzers:int,applicable_analyzers:int,completed_analyzers:int,"
    f"failed_analyzers:int,timed_out_analyzers:int,skipped_analyzers:int,not_applicable_analyzers:int,"
    f"coverage_ratio:{D},explanation:{S}>,"
    f"risk_assessment:struct<score:{D},score_based_level:{S},critical_override_applied:{B},"
    f"critical_finding_ids:array<{S}>,final_level:{S},probability:{D},probability_method:{S},limitations:array<{S}>>,"
    f"recommendation:struct<primary_action:{S},additional_actions:array<{S}>>,"
    f"cleanup:struct<status:{S},finished_at:{S},errors:{_JUDGED_ERRORS}>,"
    f"warnings:array<{S}>,errors:{_JUDGED_ERRORS}>"
)

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
LOG_EVENT = (
    f"timestamp {S}, level {S}, logger {S}, event {S}, message {S}, schema_version {S}, "
    "host string, port int"
)
LIFECYCLE_EVENT = f"analysis_id {S}, seq {L}, ts timestamp, status {S}, stage {S}"
TRANSITION_VERDICT = (
    f"analysis_id {S}, seq {L}, status {S}, stage {S}, prev_status {S}, prev_stage {S}, legal {B}, late {B}"
)
ANALYZER_ROW = (
    f"analysis_id {S}, analyzer_id {S}, analyzer_version {S}, media_type {S}, `group` {S}, "
    f"status {S}, applicable {B}, score {D}, score_name {S}, summary {S}, raw_metrics {S}, "
    f"candidate_findings array<{S}>, warnings array<{S}>, error_code {S}"
)
