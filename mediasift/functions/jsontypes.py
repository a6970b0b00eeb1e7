"""Exact reading of scalar JSON values held in variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasift.functions.base import let

# the types `schema_of_variant` names, by their first three letters
STRING, BIGINT, DECIMAL, DOUBLE, FLOAT, BOOLEAN = "STR", "BIG", "DEC", "DOU", "FLO", "BOO"
OBJECT, ARRAY, VOID = "OBJ", "ARR", "VOI"

INT_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*\z"
FLOAT_TEXT = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*\z"


def member(value: Column, key: str) -> Column:
    """Object member as a variant; SQL null when the key is missing."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def kind(value: Column) -> Column:
    """First letters of the variant's type, one of the constants above; null when missing."""
    return F.substring(F.schema_of_variant(value), 1, 3)


def members(value: Column) -> Column:
    """The members of a JSON object as a map; null for anything that is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """The items of a JSON array; null for anything that is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_missing(value: Column, key: str) -> Column:
    return member(value, key).isNull()


def is_json_null(value: Column, key: str) -> Column:
    return F.coalesce(F.is_variant_null(member(value, key)), F.lit(False))


def object_keys(value: Column) -> Column:
    return F.map_keys(members(value))


def scalar_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _text_if(value: Column, *kinds: str) -> Column:
    return F.when(kind(value).isin(*kinds), scalar_text(value))


def _digits(text: Column, pattern: str) -> Column:
    return let(text, lambda t: F.when(t.rlike(pattern), F.regexp_replace(t, r"[_\s]", "")))


def _positive(number: Column) -> Column:
    return let(number, lambda n: F.when(n > 0, n))


def positive_int(value: Column) -> Column:
    """Integer or integer-like text above zero; booleans and fractions are not integers."""
    text = _text_if(value, STRING, BIGINT)
    return _positive(_digits(text, INT_TEXT).try_cast("bigint"))


def _finite(number: Column) -> Column:
    return let(number, lambda n: F.when((n > 0) & (n < float("inf")), n))


def positive_float(value: Column) -> Column:
    """Number or number-like text above zero and finite."""
    text = _text_if(value, STRING, BIGINT, DECIMAL, DOUBLE)
    return _finite(_digits(text, FLOAT_TEXT).try_cast("double"))


def nonempty_text(value: Column) -> Column:
    return let(_text_if(value, STRING), lambda t: F.when(t != "", t))


def frame_rate(value: Column) -> Column:
    """`a/b` or a plain number, as text only; zero denominators and non-positives are null."""

    def rate(text: Column) -> Column:
        parts = F.when(text.rlike(r"^\s*[+-]?\d+/\d+\s*\z"), F.split(F.trim(text), "/"))
        ratio = let(
            parts,
            lambda p: F.try_divide(
                F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
            ),
        )
        return F.coalesce(ratio, _digits(text, FLOAT_TEXT).try_cast("double"))

    return let(_text_if(value, STRING), lambda t: _finite(rate(t)))
