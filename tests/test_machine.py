import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.operators import histories, ordered

SCHEMA = "analysis_id string, seq bigint, op string, status string, stage string, started int, finished int, route string, media_type string"


def one_by_one(rows):
    """The machine as plain steps over one task's events in order."""
    state, bound, queued, out = ("none", "none"), False, False, {}
    allowed = {("none", "none", *vocab.INITIAL_STATE), *vocab.ALLOWED_TRANSITIONS}
    for _, seq, op, status, stage, started, finished, route, media in sorted(rows, key=lambda r: r[1]):
        if op == "transition":
            ok = (*state, status, stage) in allowed and (started is not None) == (stage == "preprocessing")
            ok = ok and (finished is not None) == (stage == "finished") and (stage != "preprocessing" or queued)
            state = (status, stage) if ok else state
        elif op == "bind_route":
            ok = state[1] == "routing" and not bound and route == media
            bound |= ok
        else:
            ok = op == "enqueue" and state[1] == "queued" and not queued
            queued |= ok
        out[seq] = ok
    return out


def events(rng, sizes):
    steps = [("transition", *vocab.INITIAL_STATE), ("transition", "queued", "routing"), ("bind_route", None, None), ("transition", "queued", "queued"),
             ("enqueue", None, None), ("transition", "running", "preprocessing"), ("transition", "completed", "cleanup"), ("transition", "completed", "finished"), ("odd", None, None)]
    rows = []
    for task, n in sizes.items():
        at = 0
        for seq in rng.sample(range(10 * n), n):
            rows.append((task, seq))
        mine = sorted(r for r in rows if r[0] == task)
        rows = [r for r in rows if r[0] != task]
        for _, seq in mine:
            op, status, stage = steps[at % len(steps)] if rng.random() < 0.7 else rng.choice(steps)
            at += rng.random() < 0.8
            started = 1 if (stage == "preprocessing") != (rng.random() < 0.1) else None
            finished = 1 if (stage == "finished") != (rng.random() < 0.1) else None
            rows.append((task, seq, op, status, stage, started, finished, rng.choice(["video", "video", "audio"]), "video"))
    return rows


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_machine_takes_what_a_task_would(spark, many_partitions):
    rows = events(random.Random(3), {"hot": 400, **{f"t{i}": 1 + i % 12 for i in range(40)}})
    c = F.col
    frame = spark.createDataFrame([*rows, (None, 1, "enqueue", *[None] * 6)], SCHEMA).repartition(5)
    symbol = histories.symbol_of(c("op"), c("status"), c("stage"), started=c("started"), finished=c("finished"), route=c("route"), media_type=c("media_type"))
    out = histories.judged(frame.withColumn("symbol", symbol))
    got = {(r["analysis_id"], r["seq"]): r["accepted"] for r in out.collect()}
    want = {(t, s): ok for t in {r[0] for r in rows} for s, ok in one_by_one([r for r in rows if r[0] == t]).items()}
    assert got == want and len({ok for (t, _), ok in want.items() if t == "hot"}) == 2
    states = {r["analysis_id"]: r for r in histories.last_states(out).collect()}
    assert states["hot"]["n_refused"] == sum(not ok for (t, _), ok in want.items() if t == "hot")
    assert histories.judged(frame.where("false").withColumn("symbol", symbol)).count() == 0


def test_entries_follow_through_whole_partitions():
    n = len(histories.STATES)
    ends = [(0, "a", "b", [3] * n), (1, "b", "b", [(i + 1) % n for i in range(n)]), (4, "b", "c", [7] * n), (5, "d", "d", [2] * n)]
    assert histories._entries(ends) == [(0, 0), (1, 3), (4, 4), (5, 0)]


def test_previous_row_across_partitions(spark, many_partitions):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i, rng.choice(["x", "y", None]), rng.random()) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, n int, v string, w double")
    got = ordered.with_previous_ranged(frame, "k", "n", ["v", "w"])
    by = Window.partitionBy("k").orderBy("n")
    want = frame.withColumns({"prev_v": F.lag("v").over(by), "prev_w": F.lag("w").over(by)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert ordered.with_previous_ranged(frame.where("false"), "k", "n", ["v"]).count() == 0
