import itertools
from datetime import datetime, timedelta

import pytest

from mediasift import schemas
from mediasift.streaming import intake
from mediasift.streaming.run import run_available

T = datetime(2026, 1, 1)
PROBE = '{"format":{"format_name":"wav","duration":"2.5"},"streams":[{"codec_type":"audio","codec_name":"pcm","sample_rate":"44100","channels":2}]}'
MANIFEST = "analysis_id string, received_at timestamp, length bigint, original_name string, declared_content_type string"
FILES = f"analysis_id string, file_at timestamp, size_bytes bigint, sha256 string, header_kind string, document_type string, brands array<string>, image {schemas.IMAGE}"
PROBES = "analysis_id string, probed_at timestamp, probe_status string, probe_json string"


def at(minute):
    return T + timedelta(minutes=minute)


def rows():
    """Receipts, read files and probes: in time, early, late, missing, repeated, empty."""
    names = ["ok", "early", "late", "noprobe", "nofile", "empty", "again", "image"]
    manifest = [(n, at(60 + i), 0 if n == "empty" else 9, "x.png" if n == "image" else "x.wav", None) for i, n in enumerate(names)]
    files = [(n, at(62 + i), 9, "ab" * 32, "png" if n == "image" else "wav", None, None, None) for i, n in enumerate(names) if n not in ("nofile", "empty")]
    probes = [("ok", at(70)), ("early", at(50)), ("late", at(200)), ("nofile", at(65)), ("again", at(66)), ("stranger", at(66))]
    probes = [(n, t, "ok", PROBE) for n, t in probes] + [("again", at(64), "rejected", PROBE)]
    return {"manifest": (manifest, MANIFEST), "files": (files, FILES), "probes": (probes, PROBES)}


WANT = {
    "ok": ("accepted", None), "early": ("accepted", None), "late": ("failed", "internal_error"), "noprobe": ("failed", "internal_error"),
    "nofile": ("failed", "internal_error"), "empty": ("rejected", "file_empty"), "again": ("accepted", None),
    "image": ("failed", "internal_error"),
}


@pytest.mark.parametrize("order", list(itertools.permutations(["manifest", "files", "probes"]))[1::3])
def test_outcomes_are_those_of_the_manifest_in_any_order(spark, tmp_path, order):
    data = rows()

    def write(name, rows_, schema):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        streams = [spark.readStream.schema(data[n][1]).parquet(str(tmp_path / n)) for n in ("manifest", "files", "probes")]
        joined = intake.complete_arrivals(*streams, within_minutes=90, delay="2 hours")
        keep = intake.gate_complete(joined).select("analysis_id", "status", "error_code", "probed_at", "file_at")
        received = spark.createDataFrame(*data["manifest"])
        return {r["analysis_id"]: (r["status"], r["error_code"]) for r in intake.latest_outcomes(run_available(keep, str(tmp_path / "run")), received).collect()}

    for n in order:
        (tmp_path / n).mkdir()
    for n in order:
        for k in (0, 1):  # in two files each, the later one first
            write(n, data[n][0][::-1][k::2], data[n][1])
        got = run()
    assert {n for n, (status, _) in got.items() if status == "waiting"} == {"late", "noprobe", "nofile", "empty", "image"}
    end = {"manifest": ("end", at(9999), 1, "e.wav", None), "files": ("end", at(9999), *[None] * 6), "probes": ("end", at(9999), None, None)}
    for n, row in end.items():
        write(n, [row], data[n][1])
    assert run() == WANT
