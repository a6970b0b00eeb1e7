import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mediasift.llm import common
from mediasift.llm import simhash as sh
from mediasift.sources.shared import stored


def _brute_fingerprint(text):
    parts = text.encode().lower().split()
    shingles = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(values, most):
    values = sorted(set(values))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def _clustered(rng, centers, each, flips):
    out = []
    for _ in range(centers):
        center = rng.getrandbits(64)
        for _ in range(each):
            v = center
            for _ in range(rng.randint(0, flips)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return out


def test_fingerprints(monkeypatch, words):
    texts = ["", " \t\n", "One", "one TWO three", "ÄÖ äö x y z", words(50), words(3000), words(5)]
    expected = [_brute_fingerprint(t) for t in texts]
    assert sh._fingerprints(texts, 4).tolist() == expected
    monkeypatch.setattr(sh, "SHINGLES", 7)
    assert sh._fingerprints(texts, 4).tolist() == expected


def test_column_agrees_with_sparks_hash(spark, words):
    text = words(4)
    row = spark.createDataFrame([(text,)], "text string").select(sh.fingerprint(F.col("text")).alias("fp"), F.xxhash64("text").alias("h")).first()
    assert row.fp == row.h


@pytest.mark.parametrize("together,frontier", [(512, 2_000_000), (3, 50)])
def test_index_finds_every_link(monkeypatch, together, frontier):
    monkeypatch.setattr(sh, "TOGETHER", together)
    monkeypatch.setattr(sh, "FRONTIER", frontier)
    rng = random.Random(2)
    values = np.array(sorted(set(_clustered(rng, 20, 15, 7) + _clustered(rng, 2, 150, 2))), dtype=np.uint64)
    values = values[np.argsort(sh.gray_rank(values))]
    label = sh.GrayIndex(values, np.zeros(len(values), dtype=np.int64)).link(4)
    expected = _brute_components(values.tolist(), 4)
    ours, theirs = defaultdict(set), defaultdict(set)
    for v, x in zip(values.tolist(), label.tolist(), strict=True):
        ours[x].add(v)
        theirs[expected[v]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert sh.gray_rank(codes).tolist() == list(range(64))


@pytest.mark.parametrize("full_rows", [5_000, 40])
def test_components_over_all_buckets(spark, full_rows):
    """The same links whether buckets fit a task or are dealt again by further bits."""
    rng = random.Random(4)
    values = sorted(set(_clustered(rng, 40, 8, 6) + _clustered(rng, 1, 200, 3) + [0, 1, (1 << 64) - 1]))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long").repartition(4)
    found = {r.node: r.root for r in sh.components(sh.near_edges(fps, 4, full_rows)).collect()}
    ours, theirs = defaultdict(set), defaultdict(set)
    expected = _brute_components(values, 4)
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        ours[found.get(s, s)].add(v)
        theirs[expected[v]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in sh.components(edges).collect()} == {0}


def test_groups_of_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    fps = [_brute_fingerprint(t) for _, t in rows]
    roots = _brute_components(fps, 4)
    smallest = defaultdict(list)
    for (i, _), v in zip(rows, fps, strict=True):
        smallest[roots[v]].append((i is None, i or 0, i))
    expected = sorted(((i, v, min(smallest[roots[v]])[2]) for (i, _), v in zip(rows, fps, strict=True)), key=repr)
    out = sh.near_groups(sh.fingerprinted(odd_docs))
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out.collect()), key=repr)
    assert got == expected


def test_stage_keeps_one_of_each_group(odd_docs, no_docs, spark, words):
    kept = sh.keep_one_of_each(odd_docs)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert kept.columns == odd_docs.columns and ids == [1, 10, 11, 3, 4, 7, 8, None]
    assert sh.keep_one_of_each(no_docs).count() == 0
    data, copies = [], set()
    for g in range(30):
        base = words(250).split()
        data.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            other = list(base)
            other[17 * k] = "edited"
            data.append((10 * g + k, " ".join(other)))
            copies.add(10 * g + k)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    left = {r.doc_id for r in sh.keep_one_of_each(docs).collect()}
    assert {10 * g for g in range(30)} <= left and len(left & copies) <= 4


def _brute_kept(rows):
    """Ids that stay of (doc_id, text): by component in order of ids, unless alike to one that stays."""
    fps, sets = {}, {}
    for i, text in rows:
        w = text.lower().split()
        fps[i] = int(sh._fingerprints([text], sh.STAGE_WORDS)[0])
        sets[i] = {" ".join(w[k : k + sh.SHINGLE]) for k in range(max(1, len(w) - sh.SHINGLE + 1))} if w else set()
    roots, stay = _brute_components(fps.values(), sh.STAGE_BITS), defaultdict(list)
    for i in sorted(fps):
        mine = stay[roots[fps[i]]]
        if not any(len(sets[i] & sets[j]) >= len(sets[i] | sets[j]) * sh.ALIKE for j in mine):
            mine.append(i)
    return [i for ids in stay.values() for i in ids], max(map(len, stay.values()))


def _family(rng, words, copies, share):
    """Copies of one text of 127 words, each with that share of its words replaced."""
    base = words(127).split()
    return [" ".join(w if rng.random() > share else words(1) for w in base) for _ in range(copies)]


@pytest.mark.parametrize("first,asked", [(250_000, 1_000_000), (15_000, 10_000)])
def test_every_member_of_a_family_is_decided(spark, words, monkeypatch, first, asked):
    """Far more unlike documents in one component than are ever asked about at once."""
    monkeypatch.setattr(sh, "FIRST_SHINGLES", first, raising=False)
    monkeypatch.setattr(sh, "ASKED_SHINGLES", asked, raising=False)
    rows = list(enumerate(_family(random.Random(5), words, 300, 0.02)))
    expected, heads = _brute_kept(rows)
    assert heads > 40 and len(expected) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in sh.keep_one_of_each(docs).collect()) == sorted(expected)


def test_nothing_of_nothing(no_docs):
    assert sh.near_groups(sh.fingerprinted(no_docs)).count() == 0


@pytest.mark.parametrize("task_edges", [1, 7, 10_000])
def test_few_edges_are_united_without_rounds(spark, monkeypatch, task_edges):
    """Every round of every table cost the driver a broadcast for each stage and scan, however few edges there were."""
    rng = random.Random(9)
    pairs = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(30)]
    tables = []
    monkeypatch.setattr(sh, "stored", lambda frame, label: tables.append(label) or stored(frame, label))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    found = {r.node: r.root for r in sh.components(edges, *[task_edges][: task_edges != 10_000]).collect()}
    root = {x: x for pair in pairs for x in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if x != r}
    assert task_edges < 10_000 or len(tables) <= 2
    assert sh.components(edges.limit(0)).count() == 0


def _shuffled(spark):
    """Bytes that tasks have written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_of_lone_documents_are_in_no_shuffle(spark, words):
    """Shingles of every document, more bytes than its text, were shuffled to meet the few that have a near copy."""
    texts = [words(1000) for _ in range(400)]
    copies = [f"{t} end" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(4)
    docs = stored(docs, "test-docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = _shuffled(spark)
        kept = stored(sh.keep_one_of_each(docs), "test-kept")
        written = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert 0 < written < sum(map(len, texts)) / 3


@pytest.mark.parametrize("bits,most", [(8, 4_096), (64, 4_096), (8, 1)])
def test_no_row_is_left_unmarked(spark, monkeypatch, bits, most):
    """With one bitmap or several, and with far fewer than the rows ask for; others are marked by chance only."""
    monkeypatch.setattr(common, "MARK_BITS", bits)
    monkeypatch.setattr(common, "MOST_BITMAPS", most)
    frame = spark.range(40_000).select((F.col("id") * 3 - 60_000).alias(common.ROW))
    asked = frame.where(F.pmod(common.ROW, F.lit(5)) == 1)
    out = common.marked(frame, asked)
    assert out.columns == [common.ROW, common.MARK]
    found = {r[0]: r[1] for r in out.collect()}
    assert len(found) == 40_000 and all(found[i] for i in found if i % 5 == 1)
    others = [found[i] for i in found if i % 5 != 1]
    assert sum(others) / len(others) < {(8, 4_096): 0.14, (64, 4_096): 0.03, (8, 1): 0.3}[bits, most]
    assert not any(r[1] for r in common.marked(frame, asked.limit(0)).collect())
