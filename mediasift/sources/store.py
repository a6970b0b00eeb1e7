"""A store of rows by id that is written in part.

Ids are dealt to a fixed number of buckets. A write replaces the buckets that it touches, each as a new
folder, and then adds a manifest that says which folder holds each bucket now. A manifest appears whole or
not at all, so a reader sees all of a write or nothing of it, and keeps seeing that version while later ones
are written. A point read opens one bucket and starts no job to find it.

    <root>/data/write=<unique>/bucket=17/...     <root>/manifest/version=3/...
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift import vocab
from mediasift.sources import results

MANIFEST = "bucket int, write string, n_rows long, n_buckets int"


def bucket_of(key: Column, n_buckets: int) -> Column:
    """Bucket of an id: CRC-32 of its text, which `bucket_of_id` computes alike without Spark."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n_buckets)).cast("int")


def bucket_of_id(key: str, n_buckets: int) -> int:
    return zlib.crc32(key.encode()) % n_buckets


def is_safe(analysis_id: str) -> bool:
    """`text.is_safe_id` for one id at hand."""
    return not (
        analysis_id in ("", ".", "..")
        or re.search(r"[/\\:\x00]", analysis_id)
        or re.search(vocab.RESERVED_NAME_PATTERN.replace(r"\z", r"\Z"), analysis_id)  # Java's end of text
    )


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of the store, oldest first; a manifest without its end mark is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in files.listStatus(at)]
    whole = [n for n, p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole if n.startswith("version="))


class Snapshot:
    """One version of a store: its folders are fixed, whatever is written later."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, version: int | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        known = versions(spark, self.root) if version is None else [version]
        if not known:
            raise FileNotFoundError(f"no store at {root}")
        self.version = known[-1]
        # one row for each bucket, a number that is fixed when the store is made
        rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={self.version}").collect()
        self.n_buckets = rows[0]["n_buckets"]
        self.held = {r["bucket"]: (r["write"], r["n_rows"]) for r in rows if r["write"] is not None}

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of the given buckets, or of all, with their `bucket`; other folders are not opened."""
        wanted = sorted(self.held if buckets is None else buckets & self.held.keys())
        paths = [f"{self.root}/data/write={self.held[b][0]}/bucket={b}" for b in wanted]
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return found.select(*schema.fieldNames())

    def table(self) -> DataFrame:
        return self.rows().select(*self.schema.fieldNames())

    def get(self, key: str, value: str) -> DataFrame:
        """The row of one id, out of one bucket."""
        if not is_safe(value):
            raise ValueError("analysis id is not a safe path component")
        return self.rows({bucket_of_id(value, self.n_buckets)}).where(F.col(key) == value).select(*self.schema.fieldNames())

    def existing(self, ids: DataFrame, key: str) -> DataFrame:
        """Which of the given ids are stored (A04). Ids meet their own bucket only; others are pruned away."""
        asked = ids.withColumn("bucket", bucket_of(F.col(key), self.n_buckets))
        return asked.join(self.rows().select("bucket", key), ["bucket", key], "left_semi").drop("bucket")


def _publish(snapshot_of: tuple[SparkSession, str], rows: DataFrame, version: int, n_buckets: int, held: dict) -> None:
    """Write the buckets of `rows` as a version, then the manifest that puts them in their places."""
    spark, root = snapshot_of
    write = uuid.uuid4().hex  # what a broken write left behind is in no one's way
    data = f"{root}/data/write={write}"
    rows.repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(data)
    written = spark.read.schema(T.StructType([T.StructField("bucket", T.IntegerType())])).parquet(data)
    counts = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    now = held | {b: (write, n) for b, n in counts.items()}
    lines = [(b, *now.get(b, (None, 0)), n_buckets) for b in range(n_buckets)]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")


def create(rows: DataFrame, root: str, key: str, n_buckets: int = 1024) -> Snapshot:
    """A new store of `rows`, whose ids are unique."""
    spark, root = rows.sparkSession, root.rstrip("/")
    _publish((spark, root), rows.withColumn("bucket", bucket_of(F.col(key), n_buckets)), 0, n_buckets, {})
    return Snapshot(spark, root, rows.schema)


def upsert(store: Snapshot, incoming: DataFrame, key: str, *order: str, valid: Column | None = None) -> Snapshot:
    """Whole-row replacement by id: reads and writes the buckets of accepted rows and no others.

    Of several rows of an id the last by `order` is written (G02); rows that are not `valid` replace nothing
    and touch no bucket. Two writers from one version cannot both publish: the second one fails.
    """
    accepted = incoming if valid is None else incoming.where(valid)
    accepted = accepted.withColumn("bucket", bucket_of(F.col(key), store.n_buckets))
    touched = {r["bucket"] for r in accepted.select("bucket").distinct().collect()}  # at most the number of buckets
    if not touched:
        return store
    after = results.upsert(store.rows(touched), accepted, key, *order)
    _publish((store.spark, store.root), after, store.version + 1, store.n_buckets, store.held)
    return Snapshot(store.spark, store.root, store.schema, store.version + 1)
