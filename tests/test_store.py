import os

import pytest
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.sources import store

ROWS = [(f"id{i}", f"first {i}", i) for i in range(1000)]
SCHEMA = "analysis_id string, doc string, n int"


@pytest.fixture
def made(spark, tmp_path):
    return store.create(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "store"), "analysis_id", 200)


def incoming(spark, rows):
    return spark.createDataFrame(rows, "analysis_id string, doc string, n int, at int, ok boolean")


def buckets(before, after):
    """Buckets whose folders a write has replaced, and folders of data in all."""
    return {b for b, held in after.held.items() if before.held.get(b) != held}, sum(len([n for n in names if n.startswith("bucket=")]) for _, names, _ in os.walk(f"{after.root}/data"))


def test_an_upsert_writes_the_buckets_it_touches(spark, made):
    rows = [("id3", "late", 1, 2, True), ("id3", "early", 1, 1, True), ("new", "n", 2, 1, True), ("id9", "bad", 3, 9, False)]
    after = store.upsert(made, incoming(spark, rows), "analysis_id", "at", valid=F.col("ok"))
    touched = {store.bucket_of_id(i, 200) for i in ("id3", "new")}
    assert buckets(made, after) == (touched, len(made.held) + len(touched))
    want = {i: d for i, d, _ in ROWS} | {"id3": "late", "new": "n"}
    assert {r["analysis_id"]: r["doc"] for r in after.table().collect()} == want
    assert {r["analysis_id"]: r["doc"] for r in made.table().collect()} == {i: d for i, d, _ in ROWS}  # a reader keeps its version
    assert store.upsert(after, incoming(spark, rows[3:]), "analysis_id", "at", valid=F.col("ok")).version == 1


def test_a_point_read_opens_one_bucket(spark, made):
    one = made.get("analysis_id", "id17")
    assert len({os.path.dirname(p) for p in one.inputFiles()}) == 1
    assert [tuple(r) for r in one.collect()] == [("id17", "first 17", 17)]
    assert made.get("analysis_id", "none").count() == 0
    with pytest.raises(ValueError):
        made.get("analysis_id", "../escape")
    ids = ["", ".", "..", "a/b", "a\\b", "c:", "CON", "com1.txt", "ok", "id-1", "LPT9"]
    frame = spark.createDataFrame([(i,) for i in ids], "i string").select("i", X.is_safe_id(F.col("i")).alias("safe"))
    assert {r["i"]: r["safe"] for r in frame.collect()} == {i: store.is_safe(i) for i in ids}


def test_existence_meets_stored_rows(spark, made):
    asked = spark.createDataFrame([("id5",), ("id5",), ("x",), (None,)], "analysis_id string")
    assert [r[0] for r in made.existing(asked, "analysis_id").collect()] == ["id5", "id5"]


def test_an_unfinished_write_is_not_seen(spark, made):
    os.makedirs(f"{made.root}/manifest/version=7")
    made.rows().limit(1).write.parquet(f"{made.root}/data/write=broken")
    assert store.versions(spark, made.root) == [0]
    assert store.Snapshot(spark, made.root, made.schema).table().count() == 1000
    assert store.upsert(made, incoming(spark, [("id3", "x", 1, 1, True)]), "analysis_id", "at").version == 1


def test_the_second_of_two_writers_fails(spark, made):
    store.upsert(made, incoming(spark, [("id3", "x", 1, 1, True)]), "analysis_id", "at")
    with pytest.raises(Exception, match="(?i)exist"):
        store.upsert(made, incoming(spark, [("id4", "y", 1, 1, True)]), "analysis_id", "at")
    assert {r["doc"] for r in store.Snapshot(spark, made.root, made.schema).table().where("analysis_id in ('id3', 'id4')").collect()} == {"x", "first 4"}


def test_buckets_agree_with_spark(spark):
    frame = spark.createDataFrame([(i, store.bucket_of_id(i, 97)) for i in ("a", "ж", "id 1", "日本")], "i string, b int")
    assert frame.where(store.bucket_of(F.col("i"), 97) != F.col("b")).isEmpty()


def test_an_empty_store(spark, tmp_path):
    empty = store.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "store"), "analysis_id", 8)
    assert empty.table().count() == 0
    after = store.upsert(empty, incoming(spark, [("a", "b", 1, 1, True)]), "analysis_id", "at")
    assert after.table().count() == 1
    with pytest.raises(FileNotFoundError):
        store.Snapshot(spark, str(tmp_path / "other"), empty.schema)
