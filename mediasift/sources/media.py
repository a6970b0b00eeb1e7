"""Media bytes and intake descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas
from mediasift.functions import signature as G
from mediasift.functions import text as X
from mediasift.functions.base import let, with_fields_of
from mediasift.params import Params


def scan_media(spark: SparkSession, path: str, params: Params, *, glob: str = "*") -> DataFrame:
    """Files within the hard limit, as `binaryFile` rows.

    The length predicate is pushed to the source, which skips the content of larger files.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.col("length") <= params.hard_limit_bytes)
    )


def scan_listed(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """Every file that the source lists, without its content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "modificationTime", "length")
    )


def scan_oversized(spark: SparkSession, path: str, params: Params, *, glob: str = "*") -> DataFrame:
    """Files over the hard limit: listed, never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.col("length") > params.hard_limit_bytes)
        .select("path", "modificationTime", "length")
    )


def measure(files: DataFrame, params: Params) -> DataFrame:
    """Size, hash and signature in one pass over the bytes.

    The content ends here: only the derived columns go on, so no later shuffle carries bytes.
    """
    found = G.classify(G.header_of(F.col("content")), mpeg_before_bmff=params.mpeg_before_bmff)
    measured = let(
        found,
        lambda s: F.struct(
            F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("sha256"),
            s["kind"].alias("header_kind"),
            s["document_type"].alias("document_type"),
            s["brands"].alias("brands"),
        ),
    )
    return with_fields_of(
        files,
        measured,
        *[c for c in files.columns if c not in ("content", "length")],
    )


def source_record(
    channel: Column,
    connector: Column | None = None,
    external_system: Column | None = None,
    external_reference: Column | None = None,
) -> Column:
    """The four attribution fields and nothing else."""
    def text(c: Column | None, name: str) -> Column:
        return (F.lit(None) if c is None else c).cast("string").alias(name)

    return F.struct(
        text(channel, "channel"),
        text(connector, "connector"),
        text(external_system, "external_system"),
        text(external_reference, "external_reference"),
    ).cast(schemas.SOURCE)


def declared_as_of(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """`files` with original_name and declared_content_type of the newest declaration not after their arrival.

    declarations: path, version, declared_at, original_name, declared_content_type; every version of the
    manifest is kept, so a file registered again finds what was known when it arrived. Of one instant the
    greatest version counts, then the greatest values. A file that nothing was declared of has its own name
    and no type. The newest entry is an aggregate that combines before its shuffle; a listing has a path once.
    """
    at = files.select(F.col("path"), F.col("modificationTime").alias("_arrived")).distinct()
    entry = F.struct("declared_at", "version", "original_name", "declared_content_type")
    newest = (
        declarations.join(at, "path")
        .where(F.col("declared_at") <= F.col("_arrived"))
        .groupBy("path", "_arrived")
        .agg(F.max(entry).alias("_entry"))
        .withColumnRenamed("_arrived", "modificationTime")
    )
    own = F.element_at(F.split("path", "/"), -1)
    return (
        files.join(newest, ["path", "modificationTime"], "left")
        .withColumn("original_name", F.coalesce(F.col("_entry.original_name"), own))
        .withColumn("declared_content_type", F.col("_entry.declared_content_type"))
        .drop("_entry")
    )


def register(
    files: DataFrame,
    source: Column,
    as_of: Column,
    *,
    declarations: DataFrame | None = None,
    repeatable: bool = True,
) -> DataFrame:
    """Adds analysis_id, registered_at, source and the input descriptor columns.

    Repeatable ids come from path, length and modification time: a recomputed partition gives
    the same ids. Random ids are only safe once written. Names and declared types come from
    `declarations` where given, as of each file's arrival; register before reading bytes, or measure
    first, since that lookup shuffles the rows it gets.
    """
    new_id = (
        X.stable_id(F.col("path"), F.col("length"), F.unix_micros("modificationTime"))
        if repeatable
        else X.random_id()
    )
    registered = files.withColumns(
        {"analysis_id": new_id, "registered_at": as_of, "received_at": as_of, "source": source}
    )
    if declarations is not None:
        return declared_as_of(registered, declarations)
    return registered.withColumns(
        {
            "original_name": F.element_at(F.split("path", "/"), -1),
            "declared_content_type": F.lit(None).cast("string"),
        }
    )


def registration_valid(analysis_id: Column, registered_at_text: Column, size_bytes: Column) -> Column:
    """A safe id, a UTC time and a measured size."""
    return F.coalesce(X.is_safe_id(analysis_id) & X.is_utc_text(registered_at_text) & size_bytes.isNotNull(), F.lit(False))
