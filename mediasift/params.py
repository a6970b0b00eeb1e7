"""Run parameters: one frozen object whose values become literals in the plan."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from mediasift import vocab


@dataclass(frozen=True)
class Params:
    """Limits, retention periods and (provisional) assessment policy of one run."""

    # size limits in MiB, per media type
    image_limit_mib: int = 20
    audio_limit_mib: int = 50
    video_limit_mib: int = 200
    # backlog capacity per media type
    image_capacity: int = 4
    audio_capacity: int = 2
    video_capacity: int = 1
    # retention
    workspace_ttl_minutes: int = 60
    quarantine_ttl_hours: int = 24
    cleanup_retries: int = 3
    quarantine_enabled: bool = True
    # preprocessing grids
    fragment_seconds: int = 10
    keyframe_seconds: int = 2
    analyzer_timeout_seconds: int = 120
    normalize_images: bool = True
    build_spectrogram: bool = True
    extract_audio_track: bool = True
    extract_metadata: bool = True
    # assessment policy: provisional, carried in every output through its version
    policy_id: str = "score_model_v1"
    policy_version: str = "0.1.0"
    low_max: int = 29
    medium_max: int = 60
    weak_score: int = 5
    significant_score: int = 25
    override_enabled: bool = False
    override_finding_types: tuple[str, ...] = ()
    minimum_coverage: float = 0.5
    # export
    include_raw_metrics: bool = False
    store_original_name: bool = True
    # behaviour switches
    strict_fields: bool = True
    mpeg_before_bmff: bool = True
    # the format table may be restated, but only with the fixed content
    formats: tuple[tuple[str, str, str, str], ...] = field(default=vocab.FORMATS)

    def __post_init__(self) -> None:
        at_least_one = (
            "image_limit_mib audio_limit_mib video_limit_mib image_capacity audio_capacity "
            "video_capacity workspace_ttl_minutes quarantine_ttl_hours fragment_seconds "
            "keyframe_seconds analyzer_timeout_seconds"
        ).split()
        at_least_zero = "cleanup_retries low_max medium_max weak_score significant_score".split()
        for name in at_least_one:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in at_least_zero:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0.0 <= self.minimum_coverage <= 1.0:
            raise ValueError("minimum_coverage must lie in [0, 1]")
        if self.low_max > self.medium_max:
            raise ValueError("low_max must not exceed medium_max")
        if sorted(self.formats) != sorted(vocab.FORMATS):
            raise ValueError("formats must equal the fixed format matrix")

    def limit_bytes(self, media_type: str) -> int:
        return getattr(self, f"{media_type}_limit_mib") * vocab.MEBIBYTE

    def capacity(self, media_type: str) -> int:
        return getattr(self, f"{media_type}_capacity")

    @property
    def hard_limit_bytes(self) -> int:
        """Largest size any media type may have."""
        return max(self.limit_bytes(m) for m in vocab.MEDIA_TYPES)

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON of the parameters: one value per run."""
        text = json.dumps(
            asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False
        )
        return hashlib.sha256(text.encode("utf-8")).hexdigest()
