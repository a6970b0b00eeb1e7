import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame(list(enumerate(vectors)), schema).repartition(3)


def brute(vectors, threshold=0.9):
    """Link counts and least members of components; None for vectors that link with nothing."""
    v = np.array(vectors, dtype=np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    root = list(range(len(v)))
    for start in range(len(v)):
        if root[start] == start:
            todo = [start]
            while todo:
                at = todo.pop()
                for to in np.flatnonzero(link[at]):
                    if root[to] != start:
                        root[to] = start
                        todo.append(to)
    return link.sum(axis=1).tolist(), root


def result(frame):
    rows = sorted(frame.collect(), key=lambda r: r["vec_id"])
    return [r["n_links"] for r in rows], [r["component_id"] for r in rows], rows


def around(rng, centre, n, spread):
    return centre + rng.normal(size=(n, len(centre))) * spread


def family(rng, width=24):
    """Lone vectors, pairs, groups of several sizes and tightnesses, and exact copies."""
    parts = [rng.normal(size=(400, width))]
    for n, spread in ((2, 0.1), (2, 0.2), (5, 0.15), (14, 0.2), (30, 0.2), (90, 0.12), (150, 0.25), (70, 0.3)):
        parts += [around(rng, rng.normal(size=width), n, spread) for _ in range(2)]
    parts.append(np.repeat(rng.normal(size=(1, width)), 60, axis=0))
    out = np.concatenate(parts).astype(np.float32)
    rng.shuffle(out)
    return out


def test_finds_the_links_and_counts_dense_groups(spark, monkeypatch):
    v = family(np.random.default_rng(1))
    want_n, want_root = brute(v)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 32)
    monkeypatch.setattr(nb, "TASK_ROWS", 4000)
    n, root, rows = result(nb.near_groups(table(spark, v.tolist())))
    assert all(a <= b for a, b in zip(n, want_n))
    assert sum(n) >= 0.98 * sum(want_n) and rows[0]["recall"] >= nb.LEAST_RECALL
    assert np.mean([a == b for a, b in zip(root, want_root)]) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("spread", [0.02, 0.2, 0.35])
def test_dense_links_equal_brute_force(spark, spread, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 20)
    v = np.concatenate([around(rng, rng.normal(size=16), n, spread) for n in (150, 1, 40)]).astype(np.float32)
    group = np.repeat([0, 1, 2], [150, 1, 40]).tolist()
    copies = rng.integers(1, 5, len(v)).tolist()
    rows = [(g, i, c, x) for i, (g, c, x) in enumerate(zip(group, copies, v.tolist()))]
    got = nb.dense_links(spark.createDataFrame(rows, "group long, node long, copies long, v array<float>"), 0.9)
    u = nb.units(v)
    link = (u @ u.T >= 0.9) & (np.array(group)[:, None] == np.array(group)[None, :])
    np.fill_diagonal(link, False)
    want = {i: (int(r.sum()), int(r @ np.array(copies))) for i, r in enumerate(link) if r.any()}
    assert {r["node"]: (r["n"], r["links"]) for r in got.collect() if r["n"]} == want


def test_a_tight_group_is_counted_without_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = around(rng, rng.normal(size=8) * 10, 500, 0.01).astype(np.float32)
    monkeypatch.setattr(nb, "_compared", lambda threshold: lambda rows: 1 / 0)
    got = nb.dense_links(spark.createDataFrame([(0, i, 2, x) for i, x in enumerate(v.tolist())], "group long, node long, copies long, v array<float>"), 0.9)
    assert {(r["n"], r["links"]) for r in got.collect()} == {(499, 998)}


def test_best_of_takes_each_pair_once():
    a = np.array([1, 1, 1, 2, 1, 2])
    b = np.array([5, 6, 5, 1, 7, 1])
    out = nb.best_of(a, b, np.array([0.5, 0.9, 0.5 + 1e-16, 0.1, 0.7, 0.1]), 2)
    assert list(map(tuple, out[["a", "b"]].to_numpy().tolist())) == [(1, 6), (1, 7), (2, 1)]
    assert not len(nb.best_of(a[:0], b[:0], np.zeros(0), 2))


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (7, [2.0, 4.1]), (8, [-1.0, 2.0]), (1, None), (2, []), (4, [nan, 1.0]),
        (6, [inf, 1.0]), (9, [None, 1.0]), (10, [0.0, 0.0]), (11, [1.0]), (12, [3e38, 3e38]), (None, [-3e-38, 6e-38]), (13, [-0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, node long, __row string").withColumn("v", F.lit("v"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in nb.near_groups(frame).collect()), key=str)
    want = [(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (7, 4, 3, False), (8, 1, 8, True), (None, 1, 8, False), (12, 3 + 1, 3, False)]
    want += [(i, 0, i, True) for i in (1, 2, 4, 6, 9, 10, 11, 13)]
    assert got == sorted(want, key=str)
    assert nb.near_groups(frame.where("false")).collect() == []
    assert [tuple(r)[:4] for r in nb.near_groups(frame.where("vec_id = 1")).collect()] == [(1, 0, 1, True)]
