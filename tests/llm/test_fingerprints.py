import hashlib

from pyspark.sql import functions as F

from mediasift.llm import fingerprints as fp


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_near_the_share_of_common_shingles(spark, words):
    base = words(400)
    parts = base.split()
    texts = [base, " ".join(parts[:300]) + " " + words(100), " ".join(parts[:360]) + " " + words(40), words(400), words(7), words(3), "", None]
    rows = fp.with_fingerprint(spark.createDataFrame(enumerate(texts), "i int, text string"), "text", "packed")
    pairs = rows.alias("a").join(rows.alias("b")).select(F.col("a.i").alias("a"), F.col("b.i").alias("b"), fp.likeness(F.col("a.packed"), F.col("b.packed")).alias("near"))
    for r in pairs.collect():
        expected = _alike(texts[r.a] or "", texts[r.b] or "")
        assert abs(r.near - expected) < 0.15 and 0 <= r.near <= 1
        if r.a == r.b:
            assert r.near == 1


def test_estimate_is_not_biased(spark, words):
    data = []
    for i in range(200):
        base = words(150).split()
        data.append((i, " ".join(base), " ".join(base[:100] + words(50).split())))
    rows = spark.createDataFrame(data, "i int, a string, b string")
    out = fp.with_fingerprint(fp.with_fingerprint(rows, "a", "pa"), "b", "pb").select("i", fp.likeness(F.col("pa"), F.col("pb")).alias("near"))
    miss = [r.near - _alike(data[r.i][1], data[r.i][2]) for r in out.collect()]
    assert abs(sum(miss) / len(miss)) < 0.01


def _edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, t) in enumerate(order):
        following, n = order[(i + 1) % len(order)][1], len(t)
        out.append((k, n, hashlib.sha256((t[: n - n // 3] + following[: n // 3]).encode()).hexdigest()))
    return out


def test_edited_texts_over_many_stretches(spark, words, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 7)
    rows = [(3 * i - 100, words(i % 40)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fp.edited_pairs(docs).select("doc_id", "n_chars", F.sha2("edited", 256))
    assert sorted(map(tuple, out.collect())) == sorted(_edited(rows))


def test_odd_documents(odd_docs, no_docs):
    out = fp.edited_pairs(odd_docs).collect()
    assert sorted(len(r.text or "") for r in odd_docs.collect()) == sorted(r.n_chars for r in out)
    assert fp.edited_pairs(no_docs).count() == 0
    same = fp.with_fingerprint(odd_docs.select("doc_id", "text"), "text", "packed").where("doc_id in (1, 2)").select(fp.as_text(F.col("packed")).alias("t")).distinct()
    assert same.count() == 1 and len(same.first().t) == fp.BINS


def test_single_document_is_its_own_next(spark):
    row = fp.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert (row.n_chars, row.edited) == (6, "abcdab")
