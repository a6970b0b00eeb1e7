import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediasift.operators import lifecycle as batch
from mediasift.streaming import lifecycle
from mediasift.streaming.lifecycle import Event, History
from mediasift.streaming.run import run_available

T = datetime(2026, 1, 1)
SCHEMA = "analysis_id string, seq bigint, ts timestamp, status string, stage string"
STEPS = [("queued", "registered"), ("queued", "routing"), ("queued", "queued"), ("running", "preprocessing"), ("completed", "cleanup"), ("completed", "finished")]


def event_file(spark, path, rows):
    """Rows (id, seq, minutes, status, stage) as one more file; files are read in the order of writing."""
    rows = [(i, s, T + timedelta(minutes=m), st, sg) for i, s, m, st, sg in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def judged(spark, path, folder, files=1, **options):
    return lifecycle.run_transitions(lifecycle.event_stream(spark, path, files_per_trigger=files), folder, **options)


def test_state_survives_between_runs_and_files(spark, tmp_path):
    path, folder = str(tmp_path / "events"), str(tmp_path / "run")
    event_file(spark, path, [("a", 2, 2, "queued", "routing"), ("a", 1, 1, "queued", "registered"), ("b", 1, 1, "running", "preprocessing")])
    judged(spark, path, folder)
    event_file(spark, path, [("a", 3, 3, "queued", "queued"), ("a", 4, 4, "completed", "finished"), ("a", 2, 2, "queued", "queued"), ("a", 1, 1, "queued", "registered")])
    rows = judged(spark, path, folder).collect()
    assert sorted((r["analysis_id"], r["seq"], r["stage"], r["legal"], r["late"]) for r in rows) == [
        ("a", 1, "registered", True, False), ("a", 2, "queued", None, True), ("a", 2, "routing", True, False),
        ("a", 3, "queued", True, False), ("a", 4, "finished", False, False), ("b", 1, "preprocessing", False, False),
    ]


@pytest.mark.parametrize("files", [1, 12])
def test_verdicts_do_not_depend_on_triggers(spark, tmp_path, files):
    rng = random.Random(4)
    rows, minute = [], 0
    for task in range(30):
        for k in range(rng.randint(1, 14)):
            minute += 1
            rows.append((f"t{task}", k + 1, minute, *rng.choice(STEPS[k : k + 1] or STEPS)))
    rng.shuffle(rows)  # every event may come after all later ones: within the delay, all are judged in their places
    path = str(tmp_path / "events")
    for k in range(files):
        event_file(spark, path, rows[k::files])
    got = judged(spark, path, str(tmp_path / "run")).select("analysis_id", "seq", "legal", "late")
    table = spark.read.schema(SCHEMA).parquet(path)
    wrong = batch.illegal_transitions(table, F.lit(0)).select("analysis_id", "seq")
    assert {tuple(r) for r in got.where("not legal").select("analysis_id", "seq").collect()} == {tuple(r) for r in wrong.collect()}
    assert got.count() == len(rows) and got.where("late").isEmpty()
    assert lifecycle.unjudged(table, judged(spark, path, str(tmp_path / "run"))).isEmpty()


def test_a_correction_replaces_the_verdict_on_what_follows(spark, tmp_path):
    path, folder = str(tmp_path / "events"), str(tmp_path / "run")
    event_file(spark, path, [("a", 1, 1, *STEPS[0]), ("a", 3, 3, *STEPS[2])])
    assert {r["seq"]: r["legal"] for r in judged(spark, path, folder).collect()} == {1: True, 3: False}
    event_file(spark, path, [("a", 2, 2, *STEPS[1])])
    assert {r["seq"]: r["legal"] for r in judged(spark, path, folder).collect()} == {1: True, 2: True, 3: True}


def test_quiet_tasks_are_forgotten_by_a_timer(spark, tmp_path):
    path, folder = str(tmp_path / "events"), str(tmp_path / "run")
    event_file(spark, path, [("a", 1, 0, *STEPS[0]), ("b", 1, 0, *STEPS[0])])
    event_file(spark, path, [("b", 2, 80, *STEPS[1]), ("c", 1, 130, *STEPS[0])])
    out = judged(spark, path, folder, delay="10 minutes", ttl_minutes=90)
    assert {(r["analysis_id"], r["seq"]): r["expired"] for r in out.collect()} == {("a", 1): True, ("b", 1): False, ("b", 2): False, ("c", 1): False}
    event_file(spark, path, [("a", 2, 125, *STEPS[1]), ("b", 3, 169, *STEPS[2]), ("b", 4, 300, *STEPS[3])])
    out = judged(spark, path, folder, delay="10 minutes", ttl_minutes=90)
    got = {(r["analysis_id"], r["seq"]): (r["legal"], r["expired"]) for r in out.collect()}
    assert got == {
        ("a", 1): (True, True), ("a", 2): (False, True), ("b", 1): (True, False), ("b", 2): (True, False),
        ("b", 3): (True, True), ("b", 4): (False, False), ("c", 1): (True, True),
    }


def test_events_after_the_watermark_are_found(spark, tmp_path):
    path, folder = str(tmp_path / "events"), str(tmp_path / "run")
    event_file(spark, path, [("a", 1, 0, *STEPS[0]), ("b", 1, 500, *STEPS[0])])
    judged(spark, path, folder, delay="1 hour")
    event_file(spark, path, [("a", 2, 30, *STEPS[1]), ("b", 2, 450, *STEPS[1])])
    out = judged(spark, path, folder, delay="1 hour")
    missed = lifecycle.unjudged(spark.read.schema(SCHEMA).parquet(path), out)
    assert [(r["analysis_id"], r["seq"]) for r in missed.collect()] == [("a", 2)]


def changed_bytes(folder):
    """Bytes of the state's change logs by trigger."""
    out = {}
    for root, _, names in os.walk(f"{folder}/progress/state"):
        for n in names:
            if n.endswith(".changelog"):
                version = int(n.split(".")[0].split("_")[0])
                out[version] = out.get(version, 0) + os.path.getsize(f"{root}/{n}")
    return out


def test_what_a_trigger_writes_follows_the_changed_tasks(spark, tmp_path):
    path, folder = str(tmp_path / "events"), str(tmp_path / "run")
    event_file(spark, path, [(f"t{i}", 1, 0, *STEPS[0]) for i in range(1500)])
    event_file(spark, path, [(f"t{i}", 2, 1, *STEPS[1]) for i in range(15)])
    judged(spark, path, folder)
    written = changed_bytes(folder)
    assert written[2] * 10 < written[1]


def test_a_settled_history_keeps_one_event():
    rng = random.Random(7)
    events = [Event(k, k * 10, *rng.choice(STEPS)) for k in range(200)]
    history, whole = History(), {}
    for k in range(0, 200, 8):
        history, rows, late = history.advance(events[k : k + 8], None)
        history = history.settle(k * 10)
        assert not late and len(history.events) <= 9
        whole |= {e.seq: e.prev for e in rows}
    assert whole == {e.seq: ("none", "none") if not e.seq else (events[e.seq - 1].status, events[e.seq - 1].stage) for e in events}
    _, rows, late = history.advance([Event(3, 30, "queued", "queued")], None)
    assert not rows and [e.seq for e in late] == [3]


def test_duplicates_are_suppressed(spark, tmp_path):
    lifecycle.use_rocksdb(spark)
    path = str(tmp_path / "events")
    event_file(spark, path, [("a", 1, 0, *STEPS[0]), ("a", 1, 0, *STEPS[0]), ("b", 1, 0, *STEPS[0])])
    out = run_available(lifecycle.first_arrivals(lifecycle.event_stream(spark, path)), str(tmp_path / "run"))
    assert sorted(r["analysis_id"] for r in out.collect()) == ["a", "b"]


def test_an_event_of_a_long_history_costs_few_calls():
    """Events were copied three times each, field by field, which took most of a stream's time."""
    import cProfile
    import pstats

    events = [Event(k, k * 10, *STEPS[k % len(STEPS)]) for k in range(2_000)]
    profile = cProfile.Profile()
    history, rows, late = profile.runcall(History().advance, events, 15)
    assert len(rows) == len(history.events) == 2_000 and not late
    assert pstats.Stats(profile).total_calls < 12 * len(events)
