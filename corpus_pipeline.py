"""Cleans, mixes and tokenises the documents, stage by stage; each stage is one operator's decision."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm import exact_dedup, mixing, piece_bpe, simhash, toxicity
from mediasift.sources.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows and bytes that go to a Python worker at once at most. Whole texts are long: 10,000 of them, Spark's own
#: bound, are held by the JVM, by Arrow and as Python strings and words at the same time, and workers keep that room.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def in_small_batches(stage: Stage) -> Stage:
    """`stage`, with texts sent to Python workers in batches of bounded size from then on."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCH.items():
            spark.conf.set(name, most)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))


@in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), mixing.TILT)


@in_small_batches
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: Fingerprint links, fitted classifiers and the tokenizer are beyond SQL; tests hold them to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; each stage's result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
