"""Intake of a directory of files, end to end: scan, measure, probe, gate, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions import probe as P
from mediasift.operators import gate
from mediasift.params import Params
from mediasift.sources import media


def attach_probes(measured: DataFrame, probes: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Join probe documents and decoder metadata to measured files on analysis_id.

    Both sides carry small rows here (no file bytes). Probe documents are flattened before the
    join; kinds that need no probe find no row and keep null.
    """
    flat = probes.select("analysis_id", "probe_status", P.flatten(F.col("probe_json")).alias("probe"))
    out = measured.join(flat, "analysis_id", "left")
    if reads is not None:
        return out.join(reads.select("analysis_id", "read_status", "image"), "analysis_id", "left")
    return without_reads(out)


def without_reads(files: DataFrame) -> DataFrame:
    """Without decoder output a readable probe is taken as the safe read of audio and video."""
    return files.withColumns(
        {
            "read_status": F.when(F.col("header_kind").isin(*vocab.PROBED_KINDS), F.col("probe_status")),
            "image": F.lit(None).cast(schemas.IMAGE),
        }
    )


def _unread(registered: DataFrame) -> DataFrame:
    """Gate columns of files whose bytes are not looked at: oversized or empty."""
    absent = {
        "header_kind": "string",
        "document_type": "string",
        "brands": "array<string>",
        "probe_status": "string",
        "read_status": "string",
        "image": schemas.IMAGE,
    }
    # the hash of no bytes is known; an oversized file has none
    empty_hash = F.when(F.col("length") == 0, F.sha2(F.lit("").cast("binary"), 256))
    return (
        registered.withColumns({n: F.lit(None).cast(k) for n, k in absent.items()})
        .withColumns({"sha256": empty_hash, "probe": P.flatten(F.lit(None).cast("string"))})
        .withColumnRenamed("length", "size_bytes")
    )


def triage_directory(
    spark: SparkSession,
    path: str,
    probes: DataFrame,
    *,
    source: Column,
    as_of: Column,
    reads: DataFrame | None = None,
    manifest: DataFrame | None = None,
    declarations: DataFrame | None = None,
    params: Params | None = None,
) -> DataFrame:
    """Outcome rows of every file under `path`, oversized ones included.

    Spark's file sources list neither empty files nor names that begin with `_` or `.`. A `manifest`
    of what was received (path as the source writes it, modificationTime, length) adds every file that
    is not listed, so that each received file has an outcome: an empty one is rejected, and one whose
    bytes could not be read has failed on our side. `declarations` give names and types that were stated
    with the files (`media.declared_as_of`); without them check 8 has nothing to compare.
    """
    params = params or Params()
    small = media.register(media.scan_media(spark, path, params), source, as_of)
    measured = media.measure(small, params)
    if declarations is not None:
        measured = media.declared_as_of(measured.drop("original_name", "declared_content_type"), declarations)
    checked = attach_probes(measured, probes, reads)
    unread = media.scan_oversized(spark, path, params)
    if manifest is not None:
        listed = media.scan_listed(spark, path).select("path")
        received = manifest.select("path", "modificationTime", "length")
        unread = unread.unionByName(received.join(listed, "path", "left_anti"))
    rest = _unread(media.register(unread, source, as_of, declarations=declarations))
    return gate.validate(checked.unionByName(rest), params)


def rejections_by_source(outcomes: DataFrame, source: str = "source_name") -> DataFrame:
    """How many files each source sent, by verdict and first error code.

    One partial aggregation before a small shuffle, so a dominant source costs nothing extra.
    """
    return outcomes.groupBy(source, "status", "error_code").agg(F.count("*").alias("n_files"))
