"""Structured error records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions.base import text_map

MESSAGES = {
    "file_empty": "The file is empty.",
    "missing_extension": "The file name has no extension.",
    "unsupported_extension": "The file extension is not supported.",
    "unsupported_mime_type": "The actual file format is not supported.",
    "unsafe_or_unreadable_file": "The file could not be read safely.",
    "file_signature_mismatch": "The stated type does not match the actual file format.",
    "file_too_large": "The file exceeds the size limit.",
    "cleanup_failed": "Temporary data could not be deleted completely.",
    "internal_error": "An internal error stopped the intake of the file.",
}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(text_map(pairs), key)


def category_of(code: Column) -> Column:
    return _lookup(vocab.ERROR_CATEGORY_BY_CODE, code)


def error_record(
    code: Column,
    *,
    details: Column | None = None,
    field: str | None = None,
    messages: dict[str, str] = MESSAGES,
) -> Column:
    """Error struct for `code`; `details` is a struct or map that becomes a JSON object.

    Pass `messages` to use another language; codes and categories are fixed.
    """
    empty = F.parse_json(F.lit("{}"))
    safe_details = empty if details is None else F.coalesce(F.try_parse_json(F.to_json(details)), empty)
    return F.struct(
        code.alias("code"),
        category_of(code).alias("category"),
        _lookup(messages, code).alias("message"),
        code.isin(*vocab.RETRYABLE_CODES).alias("retryable"),
        F.lit(field).cast("string").alias("field"),
        F.lit(None).cast("string").alias("analyzer_id"),
        safe_details.alias("safe_details"),
    ).cast(schemas.ERROR)
