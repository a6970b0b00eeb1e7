import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import mixing as mx


def _brute(t, p, targets, least, rounds=2_000):
    """Weighted squares of the misses after many plain projected-gradient steps."""
    scale = targets.sum()
    gram = (p * (t / scale)[:, None]).T @ p
    weight = np.linalg.inv(gram + np.eye(len(targets)) * 1e-6 * np.trace(gram) / len(targets))
    r = np.ones(len(t))
    value = lambda r: (m := (p.T @ (r * t) - targets) / scale) @ weight @ m
    for _ in range(rounds):
        r = np.maximum(least, r - p @ weight @ ((p.T @ (r * t) - targets) / scale))
    return value(r), value


def _table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.4, 0.4], n)
    t = rng.integers(1, 500, n).astype(float)
    rows = [(int(i), int(t[i]), *map(float, p[i])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens long, __p0 double, __p1 double, __p2 double"), t, p


def test_rates_meet_their_targets(spark):
    table, t, p = _table(spark)
    now = p.T @ t
    targets = now * np.array([1.3, 0.6, 1.1])
    rate = mx.rates(table, targets)
    got = mx.totals(table, rate, 3)
    assert np.allclose(got, targets, rtol=1e-5)
    assert table.withColumn("r", rate).where("r < 0").isEmpty()


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_projection_agrees_with_brute_force(spark, least):
    """With 0 the targets can be met although many rates reach it; with 0.5 they cannot."""
    table, t, p = _table(spark, 60, 3)
    targets = (p.T @ t) * np.array([1.2, 0.2, 1.0])
    rate = np.array([r.r for r in table.withColumn("r", mx.rates(table, targets, least)).orderBy("doc_id").select("r").collect()])
    least_value, value = _brute(t, p, targets, least)
    assert rate.min() == least and value(rate) <= 1.2 * least_value + 1e-9


def test_copies_add_up(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).withColumn("c", mx.copies_of(F.lit(1.3), mx.turn_of()))
    out = rows.agg(F.min("c"), F.max("c"), F.avg("c")).first()
    assert out[0] == 1 and out[1] == 2 and abs(out[2] - 1.3) < 0.02


def _docs(spark, words, n=400):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(n):
        poor = i % 4 == 0
        text = words(rng.randint(20, 80))
        data.append((i, text.replace(" ", " ### ") if poor else text))
        if i % 2 == 0:
            labels.append((i, 0 if poor else 1, 0))
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_domains_are_told_apart_and_mixed(spark, words):
    docs, labels = _docs(spark, words)
    out, domains = mx.mixed(docs, labels)
    rows = out.collect()
    assert domains == ["quality0", "quality1"] and len(rows) == 400
    assert all((r.posterior[0] > 0.5) == (r.doc_id % 4 == 0) for r in rows)
    now = [sum(r.tokens * r.posterior[k] for r in rows) for k in (0, 1)]
    new = [sum(r.rate * r.tokens * r.posterior[k] for r in rows) for k in (0, 1)]
    assert abs(new[0] / new[1] - 0.6 * now[0] / now[1]) < 1e-3 and abs(sum(new) - sum(now)) < 1


def test_remix_loses_no_document(spark, words, odd_docs, no_docs):
    docs, labels = _docs(spark, words)
    out = mx.remix(docs, labels, {"quality1": 1.0, "quality0": 0.9})
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 400 and 400 < out.count() < 480
    labelled = spark.createDataFrame([(1, 1, 0), (7, 0, None), (None, 1, 1), (8, None, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    odd = mx.remix(odd_docs, labelled)
    assert odd.columns == odd_docs.columns and odd.count() >= odd_docs.count()
    assert mx.remix(no_docs, labelled).count() == 0 and mx.mixed(no_docs, labelled)[0].count() == 0
