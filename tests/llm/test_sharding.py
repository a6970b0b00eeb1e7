import random
import zlib
from collections import Counter, defaultdict

import pytest

from mediasift.llm import sharding as sd
from mediasift.sources.shared import new_folder


def _placed(docs, shards=24, slots=sd.SLOTS):
    spark = docs.sparkSession
    rows, folder = sd.records(docs, slots), new_folder(spark, "map")
    sd.write_map(sd.even_map(shards, slots), spark, folder)
    sd.rebalance(rows, folder)
    return sd.placed(rows, sd.read_map(spark, folder)).collect()


def _gapless(out):
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_are_near_equal(spark, words):
    rng = random.Random(1)
    data = [(i, words(rng.randint(1, 60))) for i in range(3000)]
    out = _placed(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert set(load) == set(range(24)) and max(load.values()) < 1.02 * min(load.values())
    _gapless(out)
    by_id = dict(data)
    assert all(r.size == len(by_id[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(by_id[r.doc_id].encode()) for r in out)


def test_a_row_stored_for_a_third_of_the_table(spark, words):
    rng = random.Random(4)
    data = [(i, words(rng.randint(1, 60))) for i in range(6000)] + [(77, words(30))] * 3000
    rng.shuffle(data)
    out = _placed(spark.createDataFrame(data, "doc_id long, text string").repartition(7))
    # sizes, checksums and repeats against a plain count
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    load, hot = Counter(), Counter()
    for r in out:
        load[r.shard] += r.size
        hot[r.virtual_slot] += r.doc_id == 77
    assert set(load) == set(range(24)) and max(load.values()) < 1.02 * min(load.values())
    assert max(hot.values()) < 10 and {r.map_version for r in out} == {2}
    _gapless(out)


def test_slots_do_not_depend_on_partitions(spark, words):
    data = [(i % 40, words(3) if i % 3 else "same") for i in range(300)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    slots = [Counter(map(tuple, sd.records(frame.repartition(n)).collect())) for n in (1, 5)]
    assert slots[0] == slots[1]


def test_odd_documents(odd_docs, no_docs):
    out = _placed(odd_docs)
    assert len(out) == odd_docs.count()
    _gapless(out)
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (4, 5)} == {(8, 0)}
    assert _placed(no_docs) == []


def _map(seed=2, slots=600, shards=7):
    rng = random.Random(seed)
    size = [rng.randint(1, 1000) for _ in range(slots)]
    return sd.first_map(shards, size, [1] * slots)


def test_rebalancing_edits_the_map():
    old = _map()
    size = [s * (9 if shard == 0 else 1) for s, shard in zip(old.size, old.shard)]
    skewed = old.counted(size, old.rows)
    new = skewed.rebalanced()
    assert new.version == old.version + 1 and max(skewed.loads()) > 4 * min(skewed.loads())
    assert max(new.loads()) < 1.1 * min(new.loads())
    moved = sum(a != b for a, b in zip(old.shard, new.shard))
    assert 0 < moved < 0.5 * len(size)


def test_a_new_shard_only_receives():
    old = _map()
    new = old.grown()
    assert new.shards == 8 and all(b in (a, 7) for a, b in zip(old.shard, new.shard))
    loads = new.loads()
    assert loads[7] > 0.9 * sum(loads) / 8 and max(loads) < 1.2 * sum(loads) / 8


def test_versions_are_kept(spark, tmp_path):
    old = _map()
    new = old.grown()
    for m in (old, new):
        sd.write_map(m, spark, str(tmp_path / "map"))
    assert sd.read_map(spark, str(tmp_path / "map")).shard == new.shard
    with pytest.raises(Exception, match="(?i)exist"):
        sd.write_map(new, spark, str(tmp_path / "map"))
    first = sd.read_map(spark, str(tmp_path / "map"), 1)
    assert (first.shard, first.size, first.shards) == (old.shard, old.size, 7)
