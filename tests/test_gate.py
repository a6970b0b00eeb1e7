"""One case per check, the whole format matrix, and the accepted/rejected/failed split."""

import json

import pytest
from pyspark.sql import functions as F

from mediasift import Params, schemas, vocab
from mediasift.functions import probe as P
from mediasift.operators import gate
from mediasift.operators import rules as R

SHA = "0" * 64
MIB = 1024 * 1024
KIND = {"jpg": "jpeg", "jpeg": "jpeg", "m4a": "isobmff", "mp4": "isobmff", "mov": "isobmff", "mkv": "matroska"}
VIDEO = {
    "codec_type": "video", "codec_name": "h264", "width": 64, "height": "48",
    "avg_frame_rate": "0/0", "r_frame_rate": "25/1",
}
AUDIO = {"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2}
COVER = {"codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}}


def probe(names, *streams, **container):
    return json.dumps({"format": {"format_name": names, "duration": "2.5", **container}, "streams": list(streams)})


PROBES = {
    "wav": probe("wav", AUDIO), "mp3": probe("mp3", AUDIO, COVER), "flac": probe("flac", AUDIO),
    "m4a": probe("mov,mp4,m4a", AUDIO), "mp4": probe("mov,mp4,m4a", VIDEO, AUDIO),
    "mov": probe("mov,mp4,m4a", VIDEO), "avi": probe("avi", VIDEO), "mkv": probe("matroska,webm", VIDEO),
}


def file(ext="png", **over):
    media = {f[0]: f[2] for f in vocab.FORMATS}.get(ext, "image")
    row = {
        "original_name": f"archive.tar.{ext.upper()}", "declared_content_type": None, "size_bytes": 100,
        "sha256": SHA, "header_kind": KIND.get(ext, ext), "document_type": "matroska" if ext == "mkv" else None,
        "brands": ["71742020"] if ext == "mov" else (["69736F6D"] if KIND.get(ext) == "isobmff" else None),
        "probe_status": None if media == "image" else "ok", "probe_json": PROBES.get(ext),
        "read_status": "ok", "has_image": media == "image",
    }
    return {**row, **over}


SCHEMA = (
    "i int, original_name string, declared_content_type string, size_bytes bigint, sha256 string, "
    "header_kind string, document_type string, brands array<string>, probe_status string, "
    "probe_json string, read_status string, has_image boolean"
)


def run(spark, *files, params=None):
    df = spark.createDataFrame([{"i": i, **f} for i, f in enumerate(files)], SCHEMA)
    image = F.expr(
        "named_struct('width', 1, 'height', 1, 'format', 'PNG', 'color_mode', 'RGB', 'frame_count', 1, 'has_metadata', false)"
    )
    df = df.withColumns(
        {
            "analysis_id": F.lit("a"),
            "probe": P.flatten(F.col("probe_json")),
            "image": F.when(F.col("has_image"), image).cast(schemas.IMAGE),
        }
    )
    return gate.validate(df, params).orderBy("i").collect()


def test_whole_format_matrix_is_accepted(spark):
    rows = run(spark, *[file(f[0], declared_content_type=f[1]) for f in vocab.FORMATS])
    for row, (ext, mime, media, container) in zip(rows, vocab.FORMATS, strict=True):
        assert row["status"] == "accepted", ext
        found = row["validated_file"]
        assert (found["extension"], found["detected_mime_type"], found["media_type"]) == (ext, mime, media)
        assert found["declared_mime_type"] == mime
        assert [c["code"] for c in row["validation"]["checks"]] == list(vocab.CHECKS)
        assert all(c["passed"] for c in row["validation"]["checks"])
        assert row["errors"] == []
        parameters = found["technical_parameters"]
        assert [m for m in vocab.MEDIA_TYPES if parameters[m] is not None] == [media]
        if media == "video":
            assert parameters["video"]["container"] == container
            assert parameters["video"]["fps"] == 25.0


REJECTIONS = [
    (file(size_bytes=0), "file_not_empty", "file_empty", "validation"),
    (file(original_name="plain"), "extension_present", "missing_extension", "unsupported_media"),
    (file(original_name="a.gif"), "extension_allowed", "unsupported_extension", "unsupported_media"),
    (file(header_kind=None), "file_signature_valid", "unsupported_mime_type", "unsupported_media"),
    (file("mkv", document_type="webm"), "file_signature_valid", "unsupported_mime_type", "unsupported_media"),
    (file("mkv", document_type="webm", probe_status="system_failure"), "file_signature_valid", "unsupported_mime_type", "unsupported_media"),
    (file("mkv", probe_json=probe("matroska,webm", AUDIO)), "file_signature_valid", "unsupported_mime_type", "unsupported_media"),
    (file("wav", probe_json=probe("aiff", AUDIO)), "file_signature_valid", "unsupported_mime_type", "unsupported_media"),
    (file("wav", probe_status="rejected"), "file_signature_valid", "unsafe_or_unreadable_file", "validation"),
    (file("png", original_name="renamed.jpg"), "type_consistent", "file_signature_mismatch", "validation"),
    (file(declared_content_type="image/jpeg"), "declared_mime_consistent", "file_signature_mismatch", "validation"),
    (file(declared_content_type="not a mime"), "declared_mime_consistent", "file_signature_mismatch", "validation"),
    (file(size_bytes=20 * MIB + 1), "file_size_allowed", "file_too_large", "resource_limit"),
    (file(read_status="rejected"), "safe_read_completed", "unsafe_or_unreadable_file", "validation"),
    (file("wav", probe_json=probe("wav", {**AUDIO, "sample_rate": 0})), "safe_read_completed", "unsafe_or_unreadable_file", "validation"),
    (file("mp4", probe_json=probe("mp4", {**VIDEO, "r_frame_rate": "0/0"})), "safe_read_completed", "unsafe_or_unreadable_file", "validation"),
    (file("mp4", probe_json=probe("mp4", VIDEO, {"codec_type": "audio"})), "safe_read_completed", "unsafe_or_unreadable_file", "validation"),
]


def test_one_rejection_per_check(spark):
    rows = run(spark, *[r[0] for r in REJECTIONS])
    for row, (_, check, code, category) in zip(rows, REJECTIONS, strict=True):
        assert row["status"] == "rejected", check
        checks = row["validation"]["checks"]
        assert checks[-1]["code"] == check and not checks[-1]["passed"]
        assert all(c["passed"] for c in checks[:-1])
        assert row["validated_file"] is None
        (error,) = row["errors"]
        assert (error["code"], error["category"], error["retryable"], error["field"]) == (code, category, False, "file")


def test_details_and_optional_check(spark):
    big, mismatch, silent = run(
        spark, file(size_bytes=20 * MIB + 1), file(original_name="x.jpg"), file(),
    )
    assert big["errors"][0]["safe_details"].toPython() == {
        "max_size_bytes": 20 * MIB, "observed_size_bytes": 20 * MIB + 1,
    }
    assert mismatch["errors"][0]["safe_details"].toPython() == {"detected_mime_type": "image/png"}
    codes = [c["code"] for c in silent["validation"]["checks"]]
    assert "declared_mime_consistent" not in codes and len(codes) == 11


def test_limits_are_inclusive(spark):
    rows = run(
        spark, file(size_bytes=20 * MIB), file("wav", size_bytes=50 * MIB), file("mp4", size_bytes=200 * MIB),
        file("wav", size_bytes=50 * MIB + 1),
    )
    assert [r["status"] for r in rows] == ["accepted"] * 3 + ["rejected"]


def test_hard_limit_comes_before_every_check(spark):
    (row,) = run(spark, file(original_name="plain", size_bytes=200 * MIB + 1, sha256=None))
    assert (row["status"], row["error_code"], row["validation"]) == ("rejected", "file_too_large", None)
    assert row["errors"][0]["safe_details"].toPython()["max_size_bytes"] == 200 * MIB


def test_our_failures_are_not_rejections(spark):
    rows = run(
        spark,
        file(sha256="x"),
        file(size_bytes=-1),
        file("wav", probe_status="system_failure"),
        file("wav", probe_status=None),
        file("wav", probe_json="[1]"),
        file("wav", probe_json='{"format":{"format_name":""},"streams":[]}'),
        file("wav", probe_json='{"format":{"format_name":"wav"},"streams":[1]}'),
        file(read_status="system_failure"),
        file(read_status=None),
    )
    for row in rows:
        assert (row["status"], row["error_code"], row["validation"]) == ("failed", "internal_error", None)
        assert row["errors"][0]["category"] == "internal" and row["errors"][0]["retryable"]


def test_a_failure_after_a_failed_check_does_not_count(spark):
    rows = run(
        spark, file("wav", original_name="a.gif", probe_status="system_failure"),
        file(original_name="a.jpg", read_status="system_failure"),
    )
    assert [r["error_code"] for r in rows] == ["unsupported_extension", "file_signature_mismatch"]


def test_terminal_rows_and_consistency(spark):
    df = spark.createDataFrame([{"i": i, **f} for i, f in enumerate([file(), file(size_bytes=0), file(sha256="x")])], SCHEMA)
    df = df.withColumns(
        {"analysis_id": F.lit("a"), "probe": P.flatten(F.col("probe_json")), "image": F.lit(None).cast(schemas.IMAGE)}
    )
    out = gate.validate(df.withColumn("image", F.expr("named_struct('width',1,'height',1,'format','PNG','color_mode','RGB','frame_count',1,'has_metadata',false)").cast(schemas.IMAGE)))
    ended = gate.terminal(out)
    assert ended.select("stage", "completeness_status", "final_risk_level", "n_analyzers").distinct().collect() == [
        ("finished", "not_assessed", None, 0)
    ]
    together = gate.outcome_union(gate.accepted(out), ended)
    assert together.count() == 3
    ok = gate.terminal_is_consistent(F.col("status"), F.size("errors"), F.col("validation"), F.col("validated_file"))
    assert {r[0] for r in ended.select(ok).collect()} == {True}
    rule = R.validation_rules(lambda n: F.col("validation")[n])["R07"]
    assert {r[0] for r in out.where("validation is not null").select(rule).collect()} == {True}


def test_params_are_checked():
    with pytest.raises(ValueError):
        Params(low_max=61)
    with pytest.raises(ValueError):
        Params(formats=vocab.FORMATS[1:])
    with pytest.raises(ValueError):
        Params(image_limit_mib=0)
    assert Params().hard_limit_bytes == 200 * MIB
    assert Params().fingerprint() == Params().fingerprint() != Params(weak_score=6).fingerprint()


def test_custom_limits(spark):
    rows = run(spark, file(size_bytes=2 * MIB), params=Params(image_limit_mib=1))
    assert rows[0]["error_code"] == "file_too_large"
