"""Preprocessing grids and the artifact catalog.

The artifacts of a file are one array expression over its own row, so a catalog is one scan and one
generator, and their number is known without making them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.params import Params


def _steps(duration: Column, step: int) -> Column:
    """0..n-1 where n steps of `step` seconds cover the duration; empty without duration."""
    n = F.ceil(duration / F.lit(step)).cast("bigint")
    return F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), n - 1))


def audio_fragments(media: DataFrame, params: Params | None = None) -> DataFrame:
    """[start, end) of every fragment of audio files; the last one ends with the file."""
    params = params or Params()
    step = params.fragment_seconds
    return (
        media.where("media_type = 'audio'")
        .select(
            "analysis_id", "duration_seconds",
            F.explode(_steps(F.col("duration_seconds"), step)).alias("fragment"),
        )
        .select(
            "analysis_id",
            "fragment",
            (F.col("fragment") * step).cast("double").alias("start_seconds"),
            F.least((F.col("fragment") + 1) * F.lit(float(step)), F.col("duration_seconds")).alias(
                "end_seconds"
            ),
        )
    )


def video_keyframes(media: DataFrame, params: Params | None = None) -> DataFrame:
    """Instants of key frames, from zero and before the end of the file."""
    params = params or Params()
    step = params.keyframe_seconds
    return (
        media.where("media_type = 'video'")
        .select("analysis_id", F.explode(_steps(F.col("duration_seconds"), step)).alias("keyframe"))
        .select("analysis_id", "keyframe", (F.col("keyframe") * step).cast("double").alias("at_seconds"))
    )


ARTIFACT = "struct<artifact_id:string,artifact_type:string,format:string,start_seconds:double,end_seconds:double>"


def _artifact(kind: str, fmt: str, number: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (F.lit(kind) if number is None else F.concat(F.lit(f"{kind}_"), number)).alias("artifact_id"),
        F.lit(kind).alias("artifact_type"),
        F.lit(fmt).alias("format"),
        (none if start is None else start).cast("double").alias("start_seconds"),
        (none if end is None else end).cast("double").alias("end_seconds"),
    ).cast(ARTIFACT)


def _singles(params: Params) -> list[tuple[Column, str, str]]:
    """Artifacts of which a file has one or none: condition, kind, format."""
    kind = F.col("media_type")
    wanted = [
        (params.normalize_images, kind == "image", "normalized_image", "png"),
        (params.build_spectrogram, kind == "audio", "spectrogram", "png"),
        (params.extract_audio_track, (kind == "video") & F.col("has_audio"), "extracted_audio_track", "wav"),
        (params.extract_metadata, kind.isNotNull(), "metadata_snapshot", "json"),
    ]
    return [tuple(rest) for on, *rest in wanted if on]


def artifacts(params: Params | None = None) -> Column:
    """array<ARTIFACT> of a row with media_type, duration_seconds and has_audio.

    Fragments of audio, key frames of video, then the single ones. Without a duration, or with one that is
    not positive, there are no fragments or key frames.
    """
    params = params or Params()
    kind, duration = F.col("media_type"), F.col("duration_seconds")
    step, beat = F.lit(float(params.fragment_seconds)), F.lit(float(params.keyframe_seconds))
    cut = lambda i: _artifact("audio_fragment", "wav", i, i * step, F.least((i + 1) * step, duration))
    shot = lambda i: _artifact("key_frame", "png", i, i * beat, i * beat)
    lists = [
        F.when(kind == "audio", F.transform(_steps(duration, params.fragment_seconds), cut)),
        F.when(kind == "video", F.transform(_steps(duration, params.keyframe_seconds), shot)),
        *[F.when(condition, F.array(_artifact(name, fmt))) for condition, name, fmt in _singles(params)],
    ]
    none = F.array().cast(f"array<{ARTIFACT}>")
    return F.concat(*[F.coalesce(part, none) for part in lists])


def artifact_count(params: Params | None = None) -> Column:
    """Size of `artifacts`, reckoned from the duration."""
    params = params or Params()
    kind, duration = F.col("media_type"), F.col("duration_seconds")
    steps = lambda step: F.greatest(F.ceil(duration / F.lit(step)).cast("bigint"), F.lit(0))
    parts = [
        F.when(kind == "audio", steps(params.fragment_seconds)),
        F.when(kind == "video", steps(params.keyframe_seconds)),
        *[F.when(condition, F.lit(1)) for condition, _, _ in _singles(params)],
    ]
    total = F.lit(0).cast("bigint")
    for part in parts:
        total = total + F.coalesce(part, F.lit(0))
    return total


def artifact_catalog(media: DataFrame, params: Params | None = None) -> DataFrame:
    """Every prepared artifact that must be deleted later (N03): no internal paths.

    media: analysis_id, media_type, duration_seconds, has_audio.
    """
    return media.select("analysis_id", F.inline(artifacts(params))).withColumn("must_delete", F.lit(True))
