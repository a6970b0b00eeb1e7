import numpy as np
import pytest

from mediasift.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], schema).repartition(3)


def brute(vectors, k=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    away = np.array([[n * int(a) - int(b) for a, b in zip(r, s)] for r in fit]) / n
    e, q = np.linalg.eigh(away.T @ away / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    white = np.array([[n * int(a) - int(b) for a, b in zip(r, s)] for r in x]) / n @ q / np.sqrt(e)
    return n, dev, white, e / (away * away).sum() * n


def check(frame, vectors, k=16):
    rows = frame.orderBy("vec_id", "component").collect()
    n, dev, white, share = brute(vectors, k)
    got = np.array([r["whitened"] for r in rows]).reshape(len(vectors), -1)
    assert got.shape[1] == min(k, white.shape[1])
    assert [r["deviation"] for r in rows[:: got.shape[1]]] == dev and {r["n"] for r in rows} == {n}
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8
    assert np.allclose([r["explained"] for r in rows[: got.shape[1]]], share, rtol=1e-10)
    assert max(r["identity_error"] for r in rows) < 1e-10


@pytest.mark.parametrize("start", ["zero", "spread", "equal"])
def test_rank_one_updates_keep_the_spectrum(start):
    rng = np.random.default_rng(2)
    s = wh.Spectrum(12)
    whole = np.zeros((12, 12))
    if start != "zero":
        s.values = np.sort(rng.uniform(0, 5, 12)) if start == "spread" else np.repeat([1.0, 1.0 + 1e-15, 4.0], 4)
        whole = np.diag(s.values)
    for i in range(300):
        v = rng.normal(size=12) * rng.choice([1e-9, 1.0, 1e3], size=12)
        if i % 5 == 0:
            v[rng.integers(0, 12, 8)] = 0
        if i % 7 == 0:
            v[:] = 0
        whole += np.outer(v, v)
        s.rank_one(v)
        assert np.abs(s.basis.T @ s.basis - np.eye(12)).max() < 1e-12
        assert np.abs(s.basis * s.values @ s.basis.T - whole).max() <= 1e-12 * max(1.0, np.abs(whole).max())


def test_adding_and_joining_equal_the_scatter_of_all():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 10)) @ rng.normal(size=(10, 10)) + 1e4
    parts = []
    for rows in (x[:1], x[1:90], x[90:90], x[90:400]):
        parts.append(wh.Spectrum(10))
        for r in rows:
            parts[-1].add(r)
    one = parts[0]
    for p in parts[1:]:
        one.join(p)
    away = x - x.mean(axis=0)
    assert one.n == 400 and np.allclose(one.mean, x.mean(axis=0), rtol=1e-13)
    assert np.allclose(one.values, np.linalg.eigvalsh(away.T @ away), rtol=1e-8)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(700, 24)) * np.linspace(0.3, 2, 24)).astype(np.float32)
    v = np.r_[v, v[:50], v[:1].repeat(60, axis=0)].tolist()
    monkeypatch.setattr(wh, "TASK_ROWS", 60)
    monkeypatch.setattr(wh, "FAN_IN", 3)
    check(wh.whitened(table(spark, v)), v)


def test_wide_entries_are_exact(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(40, 5)) * 30000).astype(np.float32).tolist()
    check(wh.whitened(table(spark, v)), v)


def test_few_directions(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(50, 3)) * 4) @ np.array([[1.0, 0, 2, 0, 1], [0, 1, 0, 0, 1], [0, 0, 0, 1, 0]])
    out = wh.whitened(table(spark, v.tolist()))
    assert {r["component"] for r in out.collect()} == {1, 2, 3}
    same = wh.whitened(table(spark, [[float(i == j) * s for j in range(4)] for i in range(4) for s in (8, -8)]))
    rows = same.collect()
    assert len(rows) == 32 and max(r["identity_error"] for r in rows) < 1e-10 and all(abs(r["explained"] - 0.25) < 1e-12 for r in rows)


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 9), (1, [1.0, 2.0], 9), (2, None, 9), (3, [], 9), (4, [nan, 1.0], 9), (5, [inf, 1.0], 9),
        (6, [None, 1.0], 9), (7, [1.0], 9), (8, [1.0, 2.0, 3.0], 9), (None, [0.0, -3.0], 9), (9, [5.0, 0.5], 9), (10, [1e30, 0.0], 9),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").selectExpr("*", "n AS x", "n AS deviation")
    out = wh.whitened(frame).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in out) == [(i, c) for i in ("1", "1", "9", "None") for c in (1, 2)] or len(out) == 8
    assert {r["n"] for r in out} == {3}
    assert wh.whitened(frame.where("vec_id = 1")).count() == 0
    assert wh.whitened(frame.where("false")).count() == 0
    assert wh.whitened(frame.where("vec_id in (2, 3, 4)")).count() == 0
