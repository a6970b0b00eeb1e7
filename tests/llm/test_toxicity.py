import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from mediasift.llm import toxicity as tx


def _sequential(emission, first, moves):
    """Forward-backward text by text, in plain probabilities."""
    out = np.zeros(len(emission))
    bounds = [*np.flatnonzero(first), len(emission)]
    for a, b in zip(bounds, bounds[1:]):
        e = np.exp(np.stack([np.zeros(b - a), emission[a:b]], axis=1))
        m = np.exp(moves)
        forward = [m[2] * e[0]]
        for t in range(1, b - a):
            f = (forward[-1] / forward[-1].sum()) @ m[:2] * e[t]
            forward.append(f)
        back = [np.ones(2)]
        for t in range(b - a - 1, 0, -1):
            v = m[:2] @ (e[t] * back[-1])
            back.append(v / v.sum())
        both = np.array(forward) * np.array(back[::-1])
        out[a:b] = both[:, 1] / both.sum(axis=1)
    return out


def test_marginals_of_texts_end_to_end():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 0, 40, 2, 333, 1])
    emission, moves = rng.normal(0, 3, sizes.sum()), rng.normal(0, 1, (3, 2))
    first = tx._firsts(sizes)
    assert np.allclose(tx.marginals(emission, first, moves), _sequential(emission, first, moves), atol=1e-9)
    assert len(tx.marginals(np.zeros(0), np.zeros(0, dtype=bool), moves)) == 0


def _corpus(n, seed=1):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("aeiklmnorst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    bad = ["zorgle", "blixnap", "vexomatic"]
    out = []
    for i in range(n):
        words = [rng.choice(stock) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for k in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy_and_spans(spark):
    rows = _corpus(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = tx.train(docs, labels.where(~tx.held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in tx.scored(docs, model).collect()}
    held = {r.doc_id for r in labels.where(tx.held_out(F.col("doc_id"))).collect()}
    assert len(held) > 150
    right = sum(out[i].predicted == toxic for i, _, toxic in rows if i in held)
    assert right >= 0.97 * len(held)
    for i, text, _ in rows[:200]:
        for s in out[i].spans:
            assert s.toxic >= 0.5 and set(text[s.start : s.stop].split()) <= {"zorgle", "blixnap", "vexomatic"}
    assert any(out[i].spans for i, _, toxic in rows if toxic)


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rows = _corpus(400)
    model = tx.fit([r[1] for r in rows], [r[2] for r in rows], 0.2)
    score = lambda: [s for r in rows[:50] for s in _one(model, r[1])]
    whole = _many(model, [r[1] for r in rows[:50]])
    assert np.allclose(score(), whole, atol=1e-9)


def _many(model, texts):
    words = [tx.WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    return tx._score(model, tx.marginals(tx.WordScores(model).of(words), tx._firsts(sizes), model.moves), sizes)


def _one(model, text):
    return _many(model, [text])


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    model = tx.train(odd_docs, labels)
    out = tx.scored(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (4, 5, 6)}) == 1
    assert tx.scored(no_docs, model).count() == 0
    kept = tx.keep_clean(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_without_labels_nothing_is_toxic(spark, odd_docs):
    model = tx.train(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.scored(odd_docs, model).collect()} == {0.0}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 3000)
    seen = []
    monkeypatch.setattr(tx, "fit", lambda texts, labels, share: seen.append((texts, share)))
    rows = _corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    tx.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    (texts, share), = seen
    assert 0 < len(texts) <= 20 and sum(map(len, texts)) <= 3000
    assert share == sum(r[2] for r in rows) / len(rows)


def test_words_of_the_sample_are_held_once():
    """The driver held a set of words of each sample text beside its list of words."""
    rng = random.Random(5)
    stock = [f"w{i}" for i in range(3000)]
    texts = [rng.choices(stock, k=3000) for _ in range(300)]
    labels, sample = (np.arange(300) % 2).tolist(), [" ".join(t) for t in texts]
    tracemalloc.start()
    tx.fit(sample, labels, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 53e6  # 57 MB before, 49 MB now
