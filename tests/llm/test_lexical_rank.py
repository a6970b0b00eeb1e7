import math
import random
from collections import Counter

import pytest

from mediasift.llm import lexical_rank as lex


def brute(docs, items, best=10):
    terms = [(i, lex.terms_of(t or "")) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    counts = [(i, len(t), Counter(t)) for i, t in terms]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item_id, text in items:
        want = Counter(lex.terms_of(text or ""))
        scores = []
        for i, n, c in counts:
            m = 25 + (75 * n * n_docs) // total if total else 0
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in want.items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item_id, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(5)
    docs = [(i, words(rng.randint(0, 60))) for i in range(700)]
    docs += [(700 + i, docs[i][1].upper()) for i in range(40)]  # ties
    items = [(i, words(rng.randint(1, 25))) for i in range(90)] + [(90, docs[3][1]), (91, None), (92, "zzzz9 never")]
    return docs, items


def test_equals_brute_force_with_small_tiles(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(lex.ranked(d, q)) == want
    monkeypatch.setattr(lex, "BLOCK_CHARS", 3000)
    assert got(lex.ranked(d, q)) == want


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "the quick FOX 日本語 naïve"), (1, "two one two"), (None, "word5 word6 word5"), (2, ""), (3, "no id")]
    q = spark.createDataFrame([(*x, 1, "r") for x in items], "item_id long, text string, score long, __row string")
    assert got(lex.ranked(odd_docs.withColumn("__row", odd_docs.text), q)) == brute(docs, items)
    assert got(lex.ranked(no_docs, q)) == []
    assert got(lex.ranked(odd_docs, q.where("false"))) == []


def test_only_ascii_letters_are_lowered(spark):
    assert lex.terms_of("ÀB-c_D9é\x7fZ") == ["Àb", "c", "d9é", "z"]


def test_no_partial_sum_reaches_the_limit():
    rng = random.Random(1)
    bound = 1000
    entries = [(i, t, rng.choice([0, 1, 400, 999, 1000, 1001, 3500])) for i in range(5) for t in range(40)]
    cut = lex.pieces(entries, bound)
    for columns in cut:
        sums = Counter()
        assert len({(i, t) for i, t, _ in columns}) == len(columns)
        for i, _, f in columns:
            sums[i] += f
        assert max(sums.values()) <= bound
    again = Counter()
    for columns in cut:
        for i, t, f in columns:
            again[i, t] += f
    assert again == Counter({(i, t): f for i, t, f in entries if f})
    assert (lex.EXACT - 1) // lex.IMPACT_BOUND * lex.IMPACT_BOUND < lex.EXACT


def test_an_item_of_many_repeats_is_exact(spark):
    docs = [(i, "rare " * (i % 7 + 1) + "other " * (i % 11)) for i in range(50)]
    items = [(0, "rare other " * 200_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(lex.ranked(d, q)) == brute(docs, items)
