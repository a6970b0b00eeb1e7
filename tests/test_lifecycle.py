"""Histories, backlog and retention, with hot keys and boundaries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediasift import Params, vocab
from mediasift.operators import lifecycle, ordered, retention

LEGAL = [
    ("queued", "registered"), ("queued", "routing"), ("queued", "queued"), ("running", "preprocessing"),
    ("completed", "cleanup"), ("completed", "finished"),
]


def events(spark, rows):
    return spark.createDataFrame(rows, "analysis_id string, seq bigint, status string, stage string")


def test_legal_history_has_no_findings(spark):
    rows = [("a", i, *s) for i, s in enumerate(LEGAL)]
    assert lifecycle.illegal_transitions(events(spark, rows), F.expr("seq div 2")).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_every_pair_is_judged_by_the_table(spark, chunk):
    states = [(s, g) for s in vocab.ANALYSIS_STATUSES for g in vocab.STAGES]
    rows, want = [], set()
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            key = f"{i}-{j}"
            rows += [(key, 0, *a), (key, 1, *b)]
            if (*a, *b) not in vocab.ALLOWED_TRANSITIONS:
                want.add((key, 1))
            if a != vocab.INITIAL_STATE:
                want.add((key, 0))
    found = lifecycle.illegal_transitions(events(spark, rows), F.expr(f"seq div {chunk}"))
    assert {(r["analysis_id"], r["seq"]) for r in found.collect()} == want


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_previous_state_of_a_hot_key(spark, chunk):
    rng = random.Random(chunk)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice("xyz"), rng.choice("pq")) for i in range(400)]
    last, want = {}, {}
    for key, seq, status, stage in rows:
        want[seq] = last.get(key, ("none", "none"))
        last[key] = (status, stage)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = lifecycle.with_previous_state(events(spark, shuffled), F.expr(f"seq div {chunk}"))
    assert {r["seq"]: (r["prev_status"], r["prev_stage"]) for r in found.collect()} == want


@pytest.mark.parametrize("cuts", [["t div 7", "t"], ["t div 3"], ["t div 9", "t div 3", "struct(t, substr(id, 1, 3))"]])
def test_positions_of_a_hot_group(spark, cuts):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["cold", None]), rng.choice([None, *range(20)]), f"{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, id string").repartition(7)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = ordered.with_position(df, ["g"], ["t", "id"], [F.expr(c) for c in cuts], "pos")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    assert found.columns == ["g", "t", "id", "pos"]
    want = {}
    for g in ("hot", "cold", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {row[2]: n for n, row in enumerate(mine, 1)}
    assert {r["id"]: r["pos"] for r in found.collect()} == want


def test_backlog_capacity(spark):
    t = datetime(2026, 1, 1)
    rows = [(m, t + timedelta(seconds=9 - i), f"{i}", "queued", "queued") for m in vocab.MEDIA_TYPES for i in range(6)]
    rows.append(("image", t, "x", "running", "preprocessing"))
    df = spark.createDataFrame(rows, "media_type string, queued_at timestamp, analysis_id string, status string, stage string")
    out = lifecycle.backlog(df).where("within_capacity").groupBy("media_type").agg(F.sort_array(F.collect_list("analysis_id")).alias("ids"))
    assert {r["media_type"]: r["ids"] for r in out.collect()} == {"image": ["2", "3", "4", "5"], "audio": ["4", "5"], "video": ["5"]}
    assert dict(map(tuple, lifecycle.pending_by_media(df).collect())) == {"image": 6, "audio": 6, "video": 6}


def test_stamps(spark):
    t = datetime(2026, 1, 1)
    rows = [
        ("ok", "preprocessing", t, None, False), ("ok", "cleanup", None, None, True), ("ok", "finished", None, t, False),
        ("twice", "preprocessing", t, None, False), ("twice", "preprocessing", t, None, False),
        ("none", "preprocessing", None, None, False), ("stray", "cleanup", t, t, True),
        ("late", "finished", None, None, True),
    ]
    df = spark.createDataFrame(rows, "analysis_id string, stage string, started_at timestamp, finished_at timestamp, cleanup_recorded boolean")
    got = {r["analysis_id"]: (r["start_ok"], r["finish_ok"], r["cleanup_ok"]) for r in lifecycle.stamp_report(df).collect()}
    assert got == {
        "ok": (True, True, True), "twice": (False, True, True), "none": (False, True, True),
        "stray": (False, False, True), "late": (True, False, False),
    }


def test_admission_and_routes(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "analysis_id string, n int")
    known = spark.createDataFrame([("b",)], "analysis_id string")
    assert [tuple(r) for r in lifecycle.admit(new, known, "n").collect()] == [("a", 1)]
    assert [tuple(r) for r in lifecycle.duplicate_ids(new).collect()] == [("a", 2)]
    tasks = spark.createDataFrame([("a", "image"), ("b", "audio")], "analysis_id string, media_type string")
    bound = spark.createDataFrame([("image", "image")], "media_type string, route string")
    assert [r["analysis_id"] for r in lifecycle.unbound(tasks, bound).collect()] == ["b"]
    assert {r["analysis_id"]: r["route"] for r in lifecycle.bind_routes(tasks, bound).collect()} == {"a": "image", "b": None}


NOW = datetime(2026, 1, 2, 12)
ID = "0123456789abcdef0123456789abcde"


def plan(spark, rows, active=(), params=None):
    df = spark.createDataFrame(rows, "analysis_id string, location string, mtime timestamp, is_symlink boolean, is_dir boolean")
    tasks = spark.createDataFrame([(a,) for a in active], "analysis_id string")
    out = retention.retention_plan(df, tasks, F.lit(NOW).cast("timestamp"), params)
    return {r["analysis_id"]: (r["action"], r["issue_code"], r["reported_id"]) for r in out.collect()}


def test_retention_boundaries(spark):
    hour, day, tick = timedelta(minutes=60), timedelta(hours=24), timedelta(microseconds=1)
    rows = [
        (ID + "0", "workspace", NOW - hour, False, True),
        (ID + "1", "workspace", NOW - hour + tick, False, True),
        (ID + "2", "workspace", None, False, True),
        (ID + "3", "workspace", NOW - day, False, True),
        (ID + "4", "quarantine", NOW - day, False, True),
        (ID + "5", "quarantine", NOW - day + tick, False, True),
        (ID + "6", "workspace", NOW - day, True, True),
        (ID + "7", "quarantine", NOW - day, False, False),
        ("notes", "workspace", NOW - day, False, True),
        (ID.upper() + "8", "workspace", NOW - day, False, True),
    ]
    got = plan(spark, rows, active=[ID + "3", ID + "3"])
    unsafe = ("report", "workspace_entry_unsafe", None)
    assert got == {
        ID + "0": ("delete", None, ID + "0"),
        ID + "1": ("keep", None, ID + "1"),
        ID + "2": ("report", "workspace_age_unavailable", ID + "2"),
        ID + "3": ("keep", None, ID + "3"),
        ID + "4": ("delete", None, ID + "4"),
        ID + "5": ("keep", None, ID + "5"),
        ID + "6": unsafe,
        ID + "7": ("report", "quarantine_entry_unsafe", None),
        "notes": unsafe,
        ID.upper() + "8": unsafe,
    }


def test_recovery_matrix(spark):
    rows = [("gone", False), ("gone", True)] + [("stuck", False)] * 4 + [("again", False)] * 3
    df = spark.createDataFrame(rows, "analysis_id string, ok boolean")
    decide = lambda p: {r["analysis_id"]: r["decision"] for r in retention.recovery_decision(df, p).collect()}
    assert decide(None) == {"gone": "deleted", "stuck": "quarantined", "again": "retry"}
    assert decide(Params(quarantine_enabled=False))["stuck"] == "failed"


def test_cleanup_rollup(spark):
    rows = [
        ("all", "original", True), ("all", "intermediate", True), ("some", "original", True), ("some", "intermediate", False),
        ("none", "original", False), ("none", "intermediate", False), ("plain", "original", True),
        ("kept", "original", False),
    ]
    df = spark.createDataFrame(rows, "analysis_id string, kind string, deleted boolean")
    got = {r["analysis_id"]: r["status"] for r in retention.cleanup_rollup(df).collect()}
    assert got == {"all": "completed", "some": "partial", "none": "failed", "plain": "completed", "kept": "partial"}


def test_checkpoint_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = ordered.ensure_checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/") in folder
