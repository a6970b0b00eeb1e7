import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediasift.llm import exact_dedup as ed


def test_filter_grows_and_keeps_what_is_live():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3000)]
    index = ed.CuckooFilter(4)
    places = [index.insert(k) for k in keys]
    assert index.groups * ed.SLOTS > 3000 and [index.find(k) for k in keys] == places
    for k in keys[::2]:
        assert index.delete(k) >= 0
    assert all(index.find(k) == -1 for k in keys[::2]) and all(index.find(k) >= 0 for k in keys[1::2])
    assert index.delete(keys[0]) == -1


def test_hit_on_the_tag_alone_is_no_duplicate():
    one, other = b"\x01" * 8 + b"a" * 24, b"\x01" * 8 + b"b" * 24
    index = ed.CuckooFilter()
    index.insert(one)
    assert index.find(other) == -1


def _brute(rows):
    drop = str.maketrans("", "", ed.SPACES)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(drop)].append((-len(t or ""), i is None, i or 0, i))
    return groups


def test_groups_of_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    groups = _brute(rows)
    out = ed.duplicate_groups(ed.text_keys(odd_docs)).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    for r in out:
        members = by_digest[bytes(r.digest)]
        assert r.keep_id == min(members)[3] and r.group_size == len(members)


def test_nothing_of_nothing(no_docs):
    assert ed.duplicate_groups(ed.text_keys(no_docs)).count() == 0
    assert ed.keep_one_of_each(no_docs).columns == no_docs.columns


def test_kept_documents_have_their_own_columns(odd_docs):
    kept = ed.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert kept.count() == len(_brute([(r.doc_id, r.text) for r in odd_docs.collect()]))


def test_hot_group_is_combined_before_its_bucket(spark):
    docs = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    keys = ed.text_keys(docs)
    assert ed.insertions(keys).where(F.col("digest") == F.unhex(F.sha2(F.lit("same"), 256))).count() <= 64
    hot = ed.duplicate_groups(keys).where("group_size > 1").agg(F.count("*"), F.max("group_size"), F.min("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1334, 1334, 0, 1)


def test_index_takes_insertions_and_deletions(spark):
    def changes(op, texts):
        rows = [(op, hashlib.sha256(t.encode()).digest(), 0, len(t), 1, ~i, ~i, 1) for i, t in texts]
        return spark.createDataFrame(rows, "op int, digest binary, salt int, chars long, has_id int, not_id long, not_row long, size long")

    first = ed.change_index(changes(ed.INSERT, [(1, "a"), (2, "b"), (3, "c")]), 8)
    second = ed.change_index(changes(ed.INSERT, [(4, "a"), (5, "d")]).union(changes(ed.DELETE, [(0, "b")])), 8, first)
    live = {bytes(r.digest): (~r.not_id, r.size) for r in second.where("first").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert live == {sha("a"): (1, 2), sha("c"): (3, 1), sha("d"): (5, 1)}


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_bucket_count_does_not_matter(odd_docs, buckets):
    keys = ed.text_keys(odd_docs)
    index = ed.change_index(ed.insertions(keys), buckets)
    assert index.where("first").count() == keys.select("digest").distinct().count()
