"""Registry of queries.

`QUERIES[name]` takes (spark, sf_dir) and runs a library operator over whole tables. `ORACLE[name]`
is the same question in plain SQL; where SQL cannot express the operator there is no check query,
and the tests cover it instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.params import Params

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PARAMS = Params()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def event_chunk() -> Column:
    """Event numbers are unique, so a window over one key and chunk holds 65536 rows at most."""
    return F.expr("seq div 65536")
