"""Task, source and validation records of one id: first disagreement against a plain reading of the lists."""

import random
from collections import Counter

import pytest

from mediasift.operators import reconcile

FILE = "struct<original_name:string,size_bytes:long,media_type:string>"
TASKS = f"analysis_id string, media_type string, validated_file {FILE}, n_task int"
SOURCES = "analysis_id string, task boolean"
VERDICTS = f"analysis_id string, accepted boolean, validated_file {FILE}, least_task string"
FIELDS = ("original_name", "size_bytes", "media_type")


def judged(spark, tasks, sources, verdicts):
    frames = [
        spark.createDataFrame([(*t, 1) for t in tasks], TASKS),
        spark.createDataFrame([(s, True) for s in sources], SOURCES),
        spark.createDataFrame([(*v, "x") for v in verdicts], VERDICTS),
    ]
    return reconcile.agreement(*frames)


def expected(tasks, sources, verdicts):
    out = {}
    for i in {t[0] for t in tasks} | set(sources) | {v[0] for v in verdicts}:
        t, s, v = [x for x in tasks if x[0] == i], [x for x in sources if x == i], [x for x in verdicts if x[0] == i]
        out[i] = (len(t), len(s), len(v), _first(i, t, s, v))
    return out


def _first(i, t, s, v):
    if i is None:
        return "no_id"
    for kind, rows in (("task", t), ("source", s), ("validation", v)):
        if not rows:
            return f"no_{kind}"
    if len(set(t)) > 1:
        return "several_tasks"
    if len(set(v)) > 1:
        return "several_validations"
    if not v[0][1]:
        return "not_accepted"
    if v[0][2] is None or t[0][2] is None:
        return "no_descriptor"
    for name, a, b in zip(FIELDS, t[0][2], v[0][2]):
        if a != b:
            return f"descriptor:{name}"
    return None if t[0][1] == t[0][2][2] else "media_type"


def drawn(rng, n):
    def file():
        return rng.choice([None, ("a", 1, "image"), ("a", 1, "image"), ("a", 1, "image"), (None, 1, "image"), ("a", None, "image"), ("a", 1, None)])

    ids = [None] + [f"i{k}" for k in range(n)]
    tasks = [(rng.choice(ids), rng.choice(["image", "image", "image", None]), file()) for _ in range(n)]
    verdicts = [(rng.choice(ids), rng.choice([True, True, True, False, None]), file()) for _ in range(n)]
    return tasks, [rng.choice(ids) for _ in range(2 * n)], verdicts


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_plain_reading(spark, seed):
    data = drawn(random.Random(seed), 400)
    got = {r[0]: tuple(r)[1:] for r in judged(spark, *data).collect()}
    assert got == expected(*data)
    assert len(Counter(v[3] for v in got.values())) > 6


def test_repeated_rows_of_a_hot_id_and_empty_tables(spark):
    good = ("image", ("a", 1, "image"))
    tasks, verdicts = [("hot", *good)] * 3000, [("hot", True, good[1])] * 2000
    out = judged(spark, tasks, ["hot"] * 10, verdicts)
    assert [tuple(r) for r in out.collect()] == [("hot", 3000, 10, 2000, None)]
    assert [r[0] for r in reconcile.agreeing(out).collect()] == ["hot"]
    assert judged(spark, [], [], []).count() == 0
    assert judged(spark, [], ["a"], []).first()["first_disagreement"] == "no_task"


def test_one_shuffle_and_no_join(spark):
    data = drawn(random.Random(9), 20)
    plan = judged(spark, *data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
