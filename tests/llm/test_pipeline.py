import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediasift.llm import mixing
from mediasift.llm.queries import ORACLE, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_go_through(spark, odd_docs, no_docs, tmp_path, empty):
    folder = tmp_path / "sf"
    docs = (no_docs if empty else odd_docs).select(*COLUMNS)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (7, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    read = spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, str(folder))
        if name != "sentencepiece":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
    assert read.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (read.count() == 0) == empty


def test_columns_with_names_of_the_stages_own_come_back(spark, odd_docs, tmp_path):
    """Every stage but the last returns the caller's columns with their values, and nothing else."""
    names = ["__row", "__fp", "__judged", "__tokens", "__copy", "__copies", "__turn", "__p0", "__salt", "row", "judged", "shingles", "n", "group", "fp2", "Digest2"]
    folder = tmp_path / "sf"
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (7, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    value = lambda c: F.concat_ws("-", F.lit(c), F.col("doc_id"))
    odd_docs.select(*COLUMNS).withColumns({c: value(c) for c in names}).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.count() > 0 and all(back.where(F.col(f"`{c}`") != value(c)).isEmpty() for c in names), name


def test_mixing_stage_has_the_target_of_op8(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    asked = []
    monkeypatch.setattr(mixing, "remix", lambda docs, labels, tilt=mixing.TILT: asked.append(tilt) or docs)
    corpus_pipeline.mix(spark, spark.range(1), str(tmp_path))
    assert asked == [mixing.TILT] and mixing.TILT == {"quality1": 1.0, "quality0": 0.6}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_workers_get_texts_in_small_batches(spark, odd_docs, tmp_path, name):
    """Whole texts went to a worker 10,000 at a time, which made its memory follow the length of the texts."""
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (7, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for setting in corpus_pipeline.BATCH:
        spark.conf.unset(setting)
    dict(corpus_pipeline.STAGES)[name](spark, odd_docs.select(*COLUMNS), str(tmp_path))
    sizes = spark.range(3000, numPartitions=1).mapInPandas(lambda parts: (p.iloc[:1].assign(id=len(p)) for p in parts), "id long")
    assert max(r["id"] for r in sizes.collect()) <= 500
