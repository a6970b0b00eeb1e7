"""Real files: scan, measure, gate, stream, logs."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediasift import Params
from mediasift.plans import intake
from mediasift.sources import dims, logs, media
from mediasift.streaming import intake as arrivals

FILES = {
    "photo.png": b"\x89PNG\r\n\x1a\n" + b"x" * 50,
    "renamed.jpg": b"\x89PNG\r\n\x1a\n" + b"y" * 50,
    "empty.png": b"",
    "song.mp3": b"ID3" + b"z" * 20,
    "plain": b"hello",
    "huge.wav": b"RIFF" + b"\x00" * (2 * 1024 * 1024),
}
PARAMS = Params(image_limit_mib=1, audio_limit_mib=1, video_limit_mib=1)


def as_of():
    return F.lit(datetime(2026, 1, 1)).cast("timestamp")


def source():
    return media.source_record(F.lit("api"))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for i, (name, data) in enumerate(FILES.items()):
        (root / ("sub" if i % 2 else ".") / name).write_bytes(data)
    return str(root)


def probes(spark, folder):
    audio = {"codec_type": "audio", "codec_name": "mp3", "sample_rate": "44100", "channels": 2, "duration": "3"}
    doc = json.dumps({"format": {"format_name": "mp3"}, "streams": [audio]})
    ids = media.register(media.scan_media(spark, folder, PARAMS, glob="*.mp3"), source(), as_of())
    return ids.select("analysis_id", F.lit("ok").alias("probe_status"), F.lit(doc).alias("probe_json"))


WANT = {
    "photo.png": ("rejected", "unsafe_or_unreadable_file"),
    "renamed.jpg": ("rejected", "file_signature_mismatch"),
    "empty.png": ("rejected", "file_empty"),
    "song.mp3": ("accepted", None),
    "plain": ("rejected", "missing_extension"),
    "huge.wav": ("rejected", "file_too_large"),
}


def test_directory_end_to_end(spark, folder):
    reads = media.register(media.scan_media(spark, folder, PARAMS), source(), as_of()).select(
        "analysis_id", F.when(F.col("original_name") == "photo.png", "rejected").otherwise("ok").alias("read_status"), F.lit(None).alias("image")
    )
    manifest = spark.createDataFrame([("in/empty.png", datetime(2026, 1, 1), 0), (f"file:{folder}/plain", datetime(2026, 1, 1), 5), (f"file:{folder}/.jpg", datetime(2026, 1, 1), 7)], "path string, modificationTime timestamp, length bigint")
    out = intake.triage_directory(spark, folder, probes(spark, folder), source=source(), as_of=as_of(), reads=reads, manifest=manifest, params=PARAMS)
    rows = {r["original_name"]: r for r in out.collect()}
    assert {n: (r["status"], r["error_code"]) for n, r in rows.items()} == WANT | {".jpg": ("failed", "internal_error")}
    for name, data in FILES.items():
        if name != "huge.wav":
            assert rows[name]["size_bytes"] == len(data)
            assert rows[name]["sha256"] == hashlib.sha256(data).hexdigest()
    assert rows["huge.wav"]["sha256"] is None and rows["song.mp3"]["source"]["channel"] == "api"
    assert len({r["analysis_id"] for r in rows.values()}) == len(FILES) + 1


@pytest.mark.parametrize(
    "entries, want",
    [
        ([(1, 1990, "a.mp3", "image/png"), (2, 1991, "track.mp3", "Audio/MPEG"), (3, 2990, "b.mp3", "image/png")], ("track.mp3", "accepted", None)),
        ([(1, 1990, "track.mp3", "audio/mpeg"), (2, 1990, "track.mp3", "audio/flac")], ("track.mp3", "rejected", "declared_mime_consistent")),
        ([(1, 2990, "a.mp3", "image/png")], ("song.mp3", "accepted", None)),
        ([(1, 1990, None, "?")], ("song.mp3", "rejected", "declared_mime_consistent")),
    ],
)
def test_declared_types_as_of_arrival(spark, folder, entries, want):
    path = next(r["path"] for r in media.scan_listed(spark, folder, glob="*.mp3").collect())
    rows = [(path, v, datetime(year, 1, 1), name, kind) for v, year, name, kind in entries] + [("elsewhere", 1, datetime(1990, 1, 1), "x", "y")]
    said = spark.createDataFrame(rows, "path string, version int, declared_at timestamp, original_name string, declared_content_type string")
    out = intake.triage_directory(spark, folder, probes(spark, folder), source=source(), as_of=as_of(), declarations=said, params=PARAMS)
    song = out.where(F.col("path") == path).select("original_name", "status", "failed_check").collect()
    assert [tuple(r) for r in song] == [want]


def test_registration_rules(spark):
    rows = [("a1", "2031-02-03T04:05:06Z", 1), ("a/1", "2031-02-03T04:05:06Z", 1), ("a1", "2031-02-03T04:05:06+01:00", 1), ("a1", "2031-02-03T04:05:06Z", None), (None, None, 1)]
    df = spark.createDataFrame(rows, "i string, t string, n long")
    assert [r[0] for r in df.coalesce(1).select(media.registration_valid(F.col("i"), F.col("t"), F.col("n"))).collect()] == [True, False, False, False, False]


def test_large_files_are_listed_but_not_read(spark, folder):
    plan = media.scan_media(spark, folder, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,1048576)]" in plan
    big = media.scan_oversized(spark, folder, PARAMS)
    assert "content" not in big.columns and big.count() == 1


def test_content_does_not_reach_a_shuffle(spark, folder):
    out = intake.triage_directory(spark, folder, probes(spark, folder), source=source(), as_of=as_of(), params=PARAMS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange")[1:]:
        assert "content" not in part.split("\n")[0]


def test_ids_are_repeatable(spark, folder):
    ids = lambda: sorted(r[0] for r in media.register(media.scan_media(spark, folder, PARAMS), source(), as_of()).select("analysis_id").collect())
    assert ids() == ids()


def test_arrivals_as_a_stream(spark, folder, tmp_path):
    flat = arrivals.read_arrivals(spark, folder + "/sub", PARAMS, files_per_trigger=1)
    checked = arrivals.gate_arrivals(flat, probes(spark, folder), source=source(), as_of=as_of(), params=PARAMS)
    keep = checked.select("analysis_id", "path", "modificationTime", "original_name", "status", "error_code")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    arrivals.write_latest(keep, out, progress).awaitTermination()
    rows = spark.read.parquet(out)
    assert {r["original_name"]: (r["status"], r["error_code"]) for r in rows.collect()} == {
        "renamed.jpg": WANT["renamed.jpg"], "song.mp3": WANT["song.mp3"], "huge.wav": ("rejected", "file_too_large"),
    }
    arrivals.write_latest(keep, out, progress).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_log_round_trip(spark, tmp_path):
    t = datetime(2026, 1, 1, 1, 2, 3, 4567)
    df = spark.createDataFrame([(t, "INFO", "app", "result_saved", "ж", None, 1), (t, "INFO", "app", None, "m", "h", None)], "ts timestamp, level string, logger string, event string, message string, host string, port int")
    lines = [json.loads(r[0]) for r in logs.log_line(df, F.col("ts")).collect()]
    assert lines[0] == {"timestamp": "2026-01-01T01:02:03.004Z", "level": "INFO", "logger": "app", "event": "result_saved", "message": "ж", "port": 1}
    assert lines[1]["event"] == "log" and "port" not in lines[1]
    logs.write_log(df, F.col("ts"), str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log")).count() == 2


def test_broadcast_needs_a_checked_size(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(dims.broadcast_if_small(spark.range(5), max_rows=5))
    assert not hinted(dims.broadcast_if_small(spark.range(6), max_rows=5))
