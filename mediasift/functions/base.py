"""Small building blocks shared by the column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value inside an expression, so that it is computed once.

    Wide expressions that mention a parsed document many times would otherwise be copied
    into the generated code once per mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_fields_of(df: DataFrame, record: Column, *keep: str) -> DataFrame:
    """Adds the fields of a wide record to the columns `keep` (all by default), computed once.

    The record passes through a generator of one row. A filter on its fields then reads the
    finished values: pushed below a plain projection, it would copy the whole expression and
    evaluate it a second time for every row.
    """
    return df.select(*(keep or ("*",)), F.inline(F.array(record)))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> Column:
    """Constant array<string>, as one expression."""
    return F.expr(f"cast(array({', '.join(_quoted(v) for v in values)}) AS array<string>)")


def text_map(pairs: Mapping[str, str]) -> Column:
    """Constant map<string,string>, as one expression."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in pairs.items()) + ")")


def built_once(fn):
    """Keep the columns that `fn` builds, per Spark application and arguments.

    A column is an unresolved expression, so it can be used on any number of DataFrames. Building
    the widest ones takes thousands of calls into the JVM; streams and repeated queries pay once.
    """
    kept: dict[tuple, object] = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        context = SparkContext._active_spark_context
        key = (context and context.applicationId, args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = fn(*args, **kwargs)
        return kept[key]

    return wrapper
