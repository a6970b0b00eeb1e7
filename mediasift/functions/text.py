"""Names, MIME types, identifiers, timestamps and small predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasift import vocab

_SPACE = r"[\s\x1c-\x1f]"


def nullif_empty(value: Column) -> Column:
    return F.when(value != "", value)


def file_extension(name: Column) -> Column:
    """Lower-case suffix of the last path component; both slashes separate components.

    A suffix needs a character before its dot, so `.bashrc` and `dir/.jpg` have none,
    and it may not be empty, so a trailing dot has none either.
    """
    return F.lower(nullif_empty(F.regexp_extract(name, r"[^/\\]\.([^./\\]+)\z", 1)))


def strip(value: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(value, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def is_blank(value: Column) -> Column:
    return ~value.rlike(r"(?U)[^\s\x1c-\x1f]")


def any_not_blank(values: Column) -> Column:
    """True if at least one element holds visible text."""
    return F.coalesce(F.exists(values, lambda v: ~is_blank(v)), F.lit(False))


def normalized_mime(value: Column) -> Column:
    """Type/subtype without parameters, or null when it is not a MIME token pair."""
    mime = F.lower(strip(F.split(value, ";", 2)[0]))
    return F.when(mime.rlike(vocab.MIME_PATTERN), mime)


def is_safe_id(value: Column) -> Column:
    """Usable as one file-system path component on any platform."""
    return F.coalesce(
        (value != "")
        & ~value.isin(".", "..")
        & ~value.rlike(r"[/\\:\x00]")
        & ~value.rlike(vocab.RESERVED_NAME_PATTERN),
        F.lit(False),
    )


def is_system_id(value: Column) -> Column:
    return F.coalesce(value.rlike(vocab.SYSTEM_ID_PATTERN), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(vocab.SHA256_PATTERN), F.lit(False))


def is_safe_artifact(artifact_id: Column, relative_path: Column) -> Column:
    """Artifact id shape and a relative path of plain components."""
    parts = F.filter(F.split(relative_path, "/", -1), lambda p: ~p.isin("", "."))
    plain = F.forall(
        parts,
        lambda p: p.rlike(vocab.PATH_COMPONENT_PATTERN) & ~p.rlike(vocab.RESERVED_NAME_PATTERN),
    )
    return F.coalesce(
        artifact_id.rlike(vocab.ARTIFACT_ID_PATTERN)
        & ~relative_path.startswith("/")
        & (F.size(parts) > 0)
        & plain,
        F.lit(False),
    )


def random_id() -> Column:
    """New opaque 32-digit id (B22). Not repeatable: persist rows that carry it."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """Repeatable 32-digit id, the same after a lost executor recomputes the row."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 32)


def row_fingerprint(columns: Iterable[str]) -> Column:
    """SHA-256 of the row as canonical JSON: keys sorted, compact, nulls kept."""
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with `Z`; the fraction is printed only when it is not zero.

    Expects a UTC session time zone or a timestamp without zone.
    """
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def iso_utc_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Times that exist whatever the month, in the usual form.
_CERTAIN_UTC = r"^[1-9]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?Z\z"


def is_utc_text(value: Column) -> Column:
    """A timestamp text that states offset zero; other offsets are not converted."""
    shape = value.rlike(
        r"^\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]00:?00)\z"
    )
    return F.coalesce(value.rlike(_CERTAIN_UTC) | (shape & utc_timestamp(value).isNotNull()), F.lit(False))


def utc_timestamp(value: Column) -> Column:
    """Timestamp of a text accepted by `is_utc_text`."""
    body = F.regexp_extract(
        value, r"^(\d{4}-\d{2}-\d{2})[Tt _](\d{2}:\d{2}(?::\d{2})?)(?:[.,](\d{1,6}))?", 0
    )
    plain = F.translate(body, "t_,", "TT.")
    # the cast wants seconds
    plain = F.when(F.length(plain) == 16, F.concat(plain, F.lit(":00"))).otherwise(plain)
    return F.concat(plain, F.lit("Z")).try_cast("timestamp")


def is_finite(value: Column) -> Column:
    """Null is finite: absence is judged by other rules."""
    return value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf")))


def has_non_finite_number(document: Column) -> Column:
    """True if a JSON text holds a number literal beyond the double range, such as 1e999.

    Escapes and then string literals are removed, so only structure and literals remain.
    `NaN` and `Infinity` are not JSON and already fail the parse.
    """
    bare = F.regexp_replace(F.regexp_replace(document, r"\\.", ""), r'"[^"]*+"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"[-+0-9.]++[eE][-+]?[0-9]+"), F.lit(0))
    return F.coalesce(
        F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf")), F.lit(False)
    )
