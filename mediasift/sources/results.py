"""Stored analysis results: JSON documents in, summaries and documents out
(A01-A05, A11, B18, B30, G01, G02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas
from mediasift.functions import jsontypes as J
from mediasift.functions import text as X
from mediasift.functions.base import built_once, let, with_fields_of
from mediasift.operators import rules as R
from mediasift.params import Params


def scan_documents(spark: SparkSession, directory: str) -> DataFrame:
    """One row per direct child named `*.json`: file_name, doc."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("doc"))
    )


def judge(documents: DataFrame, params: Params | None = None, *, typed_as: str = schemas.RESULT) -> DataFrame:
    """Adds `result` (typed) and `violations`; needs `doc` and, if present, uses `file_name`.

    Who needs no more of the result than its rules do passes `schemas.JUDGED`; the violations are the same.

    Order of judgement: encoding, JSON, number range, shape, then rules over typed fields.
    A document that fails an early stage is not judged by the later ones.
    """
    params = params or Params()
    shaped = with_fields_of(documents, F.struct(_first_stages(params.strict_fields).alias("_found")))
    typed = with_fields_of(shaped, F.struct(F.when(F.size("_found") == 0, F.from_json("doc", typed_as)).alias("result")))
    holds, broken = _rules("file_name" in documents.columns)
    found = F.when(F.size("_found") > 0, F.col("_found")).when(holds, _none()).otherwise(broken)
    ruled = typed.select(*documents.columns, "result", found.alias("_found"))
    # a filter on the violations stops at the generator, so that no rule is asked twice
    return with_fields_of(ruled, F.struct(F.col("_found").alias("violations")), *documents.columns, "result")


def _none() -> Column:
    return F.array().cast("array<string>")


@built_once
def _first_stages(strict: bool) -> Column:
    """Violations that `doc` has before it is typed, every stage only if the one before held; plain texts are not parsed."""
    doc = F.col("doc")

    def stages(tree: Column, described: Column) -> Column:
        # a number beyond the range is a double, which a mixed array may hide; without either there is none
        perhaps = F.coalesce(described.contains("DOUBLE") | described.contains("VARIANT"), F.lit(True))
        return (
            F.when(perhaps & X.has_non_finite_number(doc), F.array(F.lit("R01")))
            .when(R.is_plain_document(tree, described), _none())
            .when(J.members(tree).isNull(), F.array(F.lit("JSON")))
            .otherwise(R.document_shape(tree, strict=strict))
        )

    opened = let(F.try_parse_json(doc), lambda v: let(F.schema_of_variant(v), lambda d: stages(v, d)))
    return (
        F.when(R.is_plain_text(doc), _none())
        .when(~F.is_valid_utf8(doc), F.array(F.lit("UTF8")))
        .otherwise(F.coalesce(F.when(R.is_plain_beside_unknown(doc), R.unknown_fields(doc, strict=strict)), opened))
    )


@built_once
def _rules(named: bool) -> tuple[Column, Column]:
    """Whether every rule over `result` holds, and the names of those that do not.

    They stand in a projection of their own: inside a lambda nothing is compiled, and typed documents are copied."""
    result = F.col("result")
    rules = R.result_rules(result)
    rules["R26"] = X.is_safe_id(result["analysis_id"])
    if named:
        rules["R26"] = rules["R26"] & (F.col("file_name") == F.concat(result["analysis_id"], F.lit(".json")))
    return R.both(*[F.coalesce(rule, F.lit(False)) for rule in rules.values()]), R.violations(rules)


def read_results(spark: SparkSession, directory: str, params: Params | None = None) -> DataFrame:
    """Lenient read: only documents without violations."""
    return R.valid(judge(scan_documents(spark, directory), params)).select("file_name", "result")


def read_rejected(spark: SparkSession, directory: str, params: Params | None = None) -> DataFrame:
    """The other half of the lenient read, with reasons."""
    return R.rejected(judge(scan_documents(spark, directory), params)).select(
        "file_name", "doc", "violations"
    )


def get_result(
    spark: SparkSession, directory: str, analysis_id: str, params: Params | None = None
) -> DataFrame:
    """Strict point read (A03): no row when missing, an error when the document is bad.

    The file name predicate reaches the file listing, so only one document is read.
    """
    if not spark.range(1).select(X.is_safe_id(F.lit(analysis_id))).first()[0]:
        raise ValueError("analysis id is not a safe path component")
    one = scan_documents(spark, directory).where(F.col("file_name") == f"{analysis_id}.json")
    bad = F.raise_error(F.lit("Stored result is corrupted or invalid."))
    return judge(one, params).select(
        F.when(F.size("violations") == 0, F.col("result")).otherwise(bad).alias("result")
    )


def existing(ids: DataFrame, results: DataFrame) -> DataFrame:
    """Which of the given ids are stored."""
    return ids.join(results.select("analysis_id"), "analysis_id", "left_semi")


def latest_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last write wins (G02), as an aggregate: a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str, *order: str, valid: Column | None = None
) -> DataFrame:
    """Whole-row replacement by key (A05): the stored table after the write.

    Rows of `incoming` for which `valid` does not hold are refused and replace nothing. Of several the
    last by `order` is written. Both tables go through one aggregate that combines before its shuffle.
    """
    accepted = incoming if valid is None else incoming.where(valid)
    row = F.struct(*[c for c in stored.columns if c != key]).alias("row")
    written = accepted.select(key, row, F.struct(F.lit(1).alias("new"), *order).alias("turn"))
    kept = stored.select(key, row, F.lit(None).cast(written.schema["turn"].dataType).alias("turn"))
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    newest = kept.unionByName(written).groupBy(key).agg(F.max_by("row", turn).alias("row"))
    return newest.select(*[F.col(key) if c == key else F.col("row")[c].alias(c) for c in stored.columns])


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Write a new immutable version of the store next to the old ones and return its path.

    Readers keep the path of a finished version; Spark's commit protocol makes the directory
    complete before `_SUCCESS` appears.
    """
    path = f"{root}/version={version:08d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def media_type_of(result: Column) -> Column:
    """Media type of a validated file; nothing is guessed for the others."""
    return F.when(result["file"]["sha256"].isNotNull(), result["file"]["media_type"])


def summaries(results: DataFrame) -> DataFrame:
    """The seven safe columns of a listing."""
    r = F.col("result")
    return results.select(
        r["analysis_id"].alias("analysis_id"),
        X.utc_timestamp(r["created_at"]).alias("created_at"),
        X.utc_timestamp(r["updated_at"]).alias("updated_at"),
        r["status"].alias("status"),
        media_type_of(r).alias("media_type"),
        r["risk_assessment"]["final_level"].alias("final_risk_level"),
        r["completeness"]["status"].alias("completeness_status"),
    )


def recent(summary: DataFrame, limit: int) -> DataFrame:
    """Newest first, ids in code-point order within a time (G01): a distributed top-k."""
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    return summary.orderBy(F.desc("created_at"), F.asc("analysis_id")).limit(limit)


KEEP_NULLS = {"ignoreNullFields": "false"}


def _pick(value: Column, shape: str) -> Column:
    """The fields of one union member as a variant, so that no other member's keys are written."""
    names = [n.rstrip("?") for n in R.SHAPES[shape]]
    return F.parse_json(F.to_json(F.struct(*[value[n].alias(n) for n in names]), KEEP_NULLS))


def _file_variant(file: Column) -> Column:
    p = file["technical_parameters"]
    parameters = (
        F.when(file["media_type"] == "image", _pick(p, "image"))
        .when(file["media_type"] == "video", _pick(p, "video"))
        .otherwise(_pick(p, "audio"))
    )
    return F.when(file["sha256"].isNull(), _pick(file, "input_file")).otherwise(
        _pick(file.withField("technical_parameters", parameters), "validated_file")
    )


def _place_variant(place: Column) -> Column:
    first, *rest = R.vocab.LOCALIZATION_TYPES
    out = F.when(place["type"] == first, _pick(place, first))
    for name in rest:
        out = out.when(place["type"] == name, _pick(place, name))
    return out


def _with_defaults(errors: Column) -> Column:
    """Left-out `safe_details` means an empty object."""
    empty = F.parse_json(F.lit("{}"))
    return F.transform(
        errors, lambda e: e.withField("safe_details", F.coalesce(e["safe_details"], empty))
    )


def documents(results: DataFrame, params: Params | None = None) -> DataFrame:
    """JSON text of each result: nulls and empty lists kept (A11), export switches applied.

    A number beyond the double range fails the write, as it would fail the read.
    """
    params = params or Params()
    r = F.col("result")
    no_metrics = F.parse_json(F.lit("{}"))

    def analyzer(a: Column) -> Column:
        out = a.withField("errors", _with_defaults(a["errors"]))
        return out if params.include_raw_metrics else out.withField("raw_metrics", no_metrics)

    def finding(f: Column) -> Column:
        return f.withField("localization", _place_variant(f["localization"]))

    file = r["file"]
    if not params.store_original_name:
        file = file.withField("original_name", F.lit(""))
    # every new value is taken from the stored record, never from a changed one
    changed = {
        "schema_version": F.lit(R.vocab.SCHEMA_VERSION),
        "file": let(file, _file_variant),
        "analyzers": F.transform(r["analyzers"], analyzer),
        "findings": F.transform(r["findings"], finding),
        "cleanup": r["cleanup"].withField("errors", _with_defaults(r["cleanup"]["errors"])),
        "errors": _with_defaults(r["errors"]),
    }
    names = results.schema["result"].dataType.fieldNames()
    r = F.struct(*[changed.get(n, r[n]).alias(n) for n in names])
    text = F.to_json(r, KEEP_NULLS)
    checked = let(
        text,
        lambda t: F.when(
            X.has_non_finite_number(t) | ~R.finite_numbers(F.col("result")),
            F.raise_error(F.lit("JSON numbers must be finite")),
        ).otherwise(t),
    )
    return results.select(F.col("result.analysis_id").alias("analysis_id"), checked.alias("doc"))
