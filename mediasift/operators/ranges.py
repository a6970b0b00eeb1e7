"""Stretches of an ordered key with fixed bounds, so that every reading deals rows alike."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nearness of the quantiles that become bounds: this many times as fine as the stretches.
FINER = 4


def long_array(values: Sequence[int]) -> Column:
    """Constant array<bigint>, as one expression."""
    return F.expr(f"array({', '.join(f'{v}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})")


def range_bounds(df: DataFrame, key: str, rows_each: int) -> list[int]:
    """Descending values of the long column `key` that begin stretches of about `rows_each` rows.

    They are values that occur, the greatest first; none for an empty table. Only the key is read, into
    mergeable quantile sketches; the list has one number for each stretch.
    """
    rows = df.agg(F.count(F.lit(1))).first()[0]
    if not rows:
        return []
    parts = math.ceil(rows / rows_each)
    shares = [i / parts for i in range(parts - 1, 0, -1)]
    top = F.max(key).alias("top")
    if not shares:
        return [df.agg(top).first()[0]]
    accuracy = max(10_000, FINER * parts)
    row = df.agg(top, F.percentile_approx(key, shares, accuracy).alias("cuts")).first()
    return sorted({row["top"], *row["cuts"]}, reverse=True)


def range_place(key: Column, bounds: Sequence[int]) -> Column:
    """Number of the stretch a key falls into; stretch 0 has the greatest keys.

    Looked up in two steps of about the square root of all bounds.
    """
    step = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    above = lambda values: F.size(F.filter(values, lambda b: b >= key)) - 1
    group = above(long_array([g[0] for g in groups]))
    within = F.get(F.array(*[long_array(g) for g in groups]), group)
    return group * step + above(within)
