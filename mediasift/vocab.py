"""Fixed values of the data model, kept together.

Everything in this module is a constant of the public contract: the values must be
exactly these for results to agree, so they are stated plainly and nowhere else.
"""

from __future__ import annotations

# --- fixed values: enumerations ------------------------------------------------------
MEDIA_TYPES = ("image", "audio", "video")
SOURCE_CHANNELS = ("webui", "api")
ANALYSIS_STATUSES = ("queued", "running", "completed", "partial", "rejected", "failed")
STAGES = (
    "registered",
    "validation",
    "routing",
    "queued",
    "preprocessing",
    "analysis",
    "finding_formation",
    "risk_assessment",
    "result_formation",
    "cleanup",
    "persistence",
    "finished",
)
ANALYZER_STATUSES = ("completed", "skipped", "not_applicable", "error", "timeout")
SEVERITIES = ("weak", "significant", "critical")
RISK_LEVELS = ("low", "medium", "high")
COMPLETENESS_STATUSES = ("complete", "partial", "insufficient", "not_assessed")
CLEANUP_STATUSES = ("not_started", "completed", "partial", "failed")
ERROR_CATEGORIES = (
    "authentication",
    "authorization",
    "validation",
    "unsupported_media",
    "resource_limit",
    "processing",
    "analyzer",
    "storage",
    "cleanup",
    "configuration",
    "internal",
)
RECOMMENDED_ACTIONS = (
    "no_additional_action",
    "manual_review",
    "verify_source",
    "verify_source_via_independent_channel",
    "request_better_quality_source",
    "retry_analysis",
    "escalate_to_security",
    "send_to_incident_response",
)
LOCALIZATION_TYPES = ("file", "bounding_box", "time_interval", "frame_interval")
COORDINATE_SPACE = "normalized"
SCHEMA_VERSION = "1.0"
ARTIFACT_TYPES = (
    "normalized_image",
    "key_frame",
    "audio_fragment",
    "spectrogram",
    "extracted_audio_track",
    "metadata_snapshot",
)
LOG_EVENTS = (
    "application_starting",
    "configuration_loaded",
    "analysis_registered",
    "validation_started",
    "validation_rejected",
    "validation_completed",
    "preprocessing_started",
    "preprocessing_completed",
    "analyzer_started",
    "analyzer_finished",
    "analyzer_failed",
    "risk_assessment_completed",
    "cleanup_started",
    "cleanup_completed",
    "cleanup_failed",
    "result_saved",
    "analysis_completed",
    "analysis_partial",
    "analysis_failed",
)
LOG_FIELDS = (
    "timestamp",
    "level",
    "logger",
    "event",
    "message",
    "schema_version",
    "host",
    "port",
)

# --- fixed values: supported formats (extension, MIME type, media type, container) ----
FORMATS = (
    ("jpg", "image/jpeg", "image", "jpeg"),
    ("jpeg", "image/jpeg", "image", "jpeg"),
    ("png", "image/png", "image", "png"),
    ("webp", "image/webp", "image", "webp"),
    ("wav", "audio/wav", "audio", "wav"),
    ("mp3", "audio/mpeg", "audio", "mp3"),
    ("flac", "audio/flac", "audio", "flac"),
    ("m4a", "audio/mp4", "audio", "m4a"),
    ("mp4", "video/mp4", "video", "mp4"),
    ("mov", "video/quicktime", "video", "mov"),
    ("avi", "video/x-msvideo", "video", "avi"),
    ("mkv", "video/x-matroska", "video", "mkv"),
)

# --- fixed values: the order of the validation checks ---------------------------------
CHECKS = (
    "file_not_empty",
    "extension_present",
    "extension_allowed",
    "file_signature_valid",
    "detected_mime_allowed",
    "media_type_supported",
    "type_consistent",
    "declared_mime_consistent",
    "file_size_allowed",
    "safe_read_completed",
    "technical_parameters_available",
    "sha256_available",
)

# --- fixed values: error codes and their categories -----------------------------------
ERROR_CATEGORY_BY_CODE = {
    "file_empty": "validation",
    "missing_extension": "unsupported_media",
    "unsupported_extension": "unsupported_media",
    "unsupported_mime_type": "unsupported_media",
    "unsafe_or_unreadable_file": "validation",
    "file_signature_mismatch": "validation",
    "file_too_large": "resource_limit",
    "cleanup_failed": "cleanup",
    "internal_error": "internal",
}
RETRYABLE_CODES = ("cleanup_failed", "internal_error")

# --- fixed values: lifecycle (status, stage) -> allowed next (status, stage) -----------
INITIAL_STATE = ("queued", "registered")
ALLOWED_TRANSITIONS = (
    ("queued", "registered", "queued", "routing"),
    ("queued", "routing", "queued", "queued"),
    ("queued", "queued", "running", "preprocessing"),
    ("queued", "queued", "failed", "cleanup"),
    ("running", "preprocessing", "completed", "cleanup"),
    ("running", "preprocessing", "failed", "cleanup"),
    ("completed", "cleanup", "completed", "finished"),
    ("failed", "cleanup", "failed", "finished"),
)

# --- fixed values: limits, patterns, byte signatures -----------------------------------
HEADER_BYTES = 64 * 1024
MEBIBYTE = 1024 * 1024
SHA256_PATTERN = r"^[0-9a-f]{64}\z"
SYSTEM_ID_PATTERN = r"^[0-9a-f]{32}\z"
ARTIFACT_ID_PATTERN = r"^[a-z][a-z0-9_]{0,63}\z"
PATH_COMPONENT_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9_.-]{0,127}\z"
MIME_PATTERN = r"^[!#$%&'*+.^_`|~0-9a-z-]+/[!#$%&'*+.^_`|~0-9a-z-]+\z"
# Device names Windows reserves, with any suffix after a dot.
RESERVED_NAME_PATTERN = (
    r"(?i)^(con|prn|aux|nul|conin\$|conout\$|(com|lpt)[1-9¹²³]) *(\.|\z)"
)
EBML_MAGIC = "1A45DFA3"
EBML_DOCTYPE_ID = "4282"
EBML_DOCTYPES = ("matroska", "webm")
PROBED_KINDS = ("wav", "mp3", "flac", "avi", "matroska", "isobmff")
ISO_BMFF_FORMAT_NAMES = ("mov", "mp4", "m4a")
