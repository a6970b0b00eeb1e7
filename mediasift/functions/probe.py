"""Container probe documents: flattening, parameters and format resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.functions import jsontypes as J
from mediasift.functions.base import let, text_array, text_map
from mediasift.params import Params


def _is_attached_picture(stream: Column) -> Column:
    flag = J.member(J.member(stream, "disposition"), "attached_pic")
    return F.coalesce(F.try_variant_get(flag, "$", "double") == 1.0, F.lit(False))


def flatten(probe_json: Column) -> Column:
    """Well-formed probe as a struct; null for anything else, which is a system failure.

    Fields: format_names, format_duration, format_bitrate, audio, video (streams of each
    kind in file order, cover pictures left out).
    """
    return let(F.try_parse_json(probe_json), _flatten_document)


def _flatten_document(doc: Column) -> Column:
    container = J.member(doc, "format")
    streams = F.try_variant_get(doc, "$.streams", "array<variant>")
    name = J.nonempty_text(J.member(container, "format_name"))
    well_formed = (
        (J.kind(doc) == J.OBJECT)
        & (J.kind(container) == J.OBJECT)
        & (J.kind(J.member(doc, "streams")) == J.ARRAY)
        & name.isNotNull()
        & F.forall(streams, lambda s: J.kind(s) == J.OBJECT)
    )

    def codec_type(stream: Column) -> Column:
        return J.nonempty_text(J.member(stream, "codec_type"))

    audio = F.filter(streams, lambda s: codec_type(s) == "audio")
    video = F.filter(streams, lambda s: (codec_type(s) == "video") & ~_is_attached_picture(s))
    return F.when(
        well_formed,
        F.struct(
            F.array_distinct(F.split(name, ",", -1)).alias("format_names"),
            J.positive_float(J.member(container, "duration")).alias("format_duration"),
            J.positive_int(J.member(container, "bit_rate")).alias("format_bitrate"),
            audio.alias("audio"),
            video.alias("video"),
        ),
    )


def has_streams(streams: Column) -> Column:
    return F.coalesce(F.size(streams) > 0, F.lit(False))


def audio_parameters(probe: Column) -> Column:
    """Parameters of the first audio stream, null if a required one is missing."""
    return let(F.get(probe["audio"], F.lit(0)), lambda s: _audio_record(s, probe))


def _audio_record(s: Column, probe: Column) -> Column:
    record = F.struct(
        F.coalesce(J.positive_float(J.member(s, "duration")), probe["format_duration"]).alias(
            "duration_seconds"
        ),
        J.positive_int(J.member(s, "sample_rate")).try_cast("int").alias("sample_rate_hz"),
        J.positive_int(J.member(s, "channels")).try_cast("int").alias("channels"),
        J.nonempty_text(J.member(s, "codec_name")).alias("codec"),
        F.coalesce(J.positive_int(J.member(s, "bit_rate")), probe["format_bitrate"]).alias(
            "bitrate_bps"
        ),
    )
    required = ("duration_seconds", "sample_rate_hz", "channels", "codec")
    return let(record, lambda r: _complete(r, required))


def _complete(record: Column, required: tuple[str, ...], also: Column | None = None) -> Column:
    whole = F.lit(True) if also is None else also
    for name in required:
        whole = whole & record[name].isNotNull()
    return F.when(whole, record)


def video_parameters(probe: Column, container: Column) -> Column:
    """Parameters of the first video stream and the first audio codec."""
    return let(
        F.struct(
            F.get(probe["video"], F.lit(0)).alias("video"),
            F.get(probe["audio"], F.lit(0)).alias("audio"),
        ),
        lambda first: _video_record(first["video"], first["audio"], probe, container),
    )


def _video_record(v: Column, a: Column, probe: Column, container: Column) -> Column:
    fps = F.coalesce(
        J.frame_rate(J.member(v, "avg_frame_rate")), J.frame_rate(J.member(v, "r_frame_rate"))
    )
    record = F.struct(
        F.coalesce(J.positive_float(J.member(v, "duration")), probe["format_duration"]).alias(
            "duration_seconds"
        ),
        container.alias("container"),
        J.nonempty_text(J.member(v, "codec_name")).alias("video_codec"),
        J.nonempty_text(J.member(a, "codec_name")).alias("audio_codec"),
        J.positive_int(J.member(v, "width")).try_cast("int").alias("width"),
        J.positive_int(J.member(v, "height")).try_cast("int").alias("height"),
        fps.alias("fps"),
        F.coalesce(J.positive_int(J.member(v, "bit_rate")), probe["format_bitrate"]).alias(
            "bitrate_bps"
        ),
        a.isNotNull().alias("has_audio"),
    )
    required = ("duration_seconds", "video_codec", "width", "height", "fps")
    return let(
        record,
        lambda r: _complete(r, required, ~r["has_audio"] | r["audio_codec"].isNotNull()),
    )


def resolved_extension(kind: Column, brands: Column, probe: Column) -> Column:
    """Canonical extension of the detected format, null when it cannot be decided."""
    names = probe["format_names"]
    moving = has_streams(probe["video"])
    sounding = has_streams(probe["audio"])
    is_bmff = (kind == "isobmff") & F.arrays_overlap(
        names, text_array(vocab.ISO_BMFF_FORMAT_NAMES)
    )
    quicktime = F.array_contains(brands, "71742020")
    return (
        F.when(kind == "jpeg", "jpg")
        .when(kind.isin("png", "webp"), kind)
        .when(kind.isin("wav", "mp3", "flac", "avi"), F.when(F.array_contains(names, kind), kind))
        .when(kind == "matroska", F.when(moving, "mkv"))
        .when(is_bmff & quicktime & moving, "mov")
        .when(is_bmff & moving, "mp4")
        .when(is_bmff & sounding, "m4a")
    )


def size_limit_bytes(media_type: Column, params: Params) -> Column:
    """Byte limit of a media type."""
    first, *rest = vocab.MEDIA_TYPES
    limit = F.when(media_type == first, F.lit(params.limit_bytes(first)))
    for name in rest:
        limit = limit.when(media_type == name, F.lit(params.limit_bytes(name)))
    return limit.cast("bigint")


def format_field(extension: Column, field: str) -> Column:
    """One column of the fixed format matrix, looked up by extension."""
    at = {"mime": 1, "media_type": 2, "container": 3}[field]
    return F.try_element_at(text_map({row[0]: row[at] for row in vocab.FORMATS}), extension)
