"""What several text operators share: whole texts, row numbers, joins that no hot key can hold up."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt before anything is grouped by that key.
SALTS = 64

ROW = "__row"
SALT = "__salt"
MARK = "__mark"

#: Bits of one bitmap of Spark's, bits for each marked row, and the bitmaps that go to every task at most (16 MB).
BITMAP, MARK_BITS, MOST_BITMAPS = 32_768, 8, 4_096


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def salt_of(column: str = ROW) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str = ROW) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for each `key`.

    The rows of a key are first reduced to one pair (key, salt) for each salt, combined before the
    shuffle; the pairs meet the table, and the rows then join on the pair. A key that holds a third of
    all rows is thus spread over `SALTS` parts. The salt comes from the column `by`.
    """
    salted = rows.withColumn(SALT, salt_of(by))
    pairs = salted.select(key, SALT).distinct().join(table, key)
    return salted.join(pairs, [key, SALT]).drop(SALT)


def marked(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """`frame` with `MARK`: true for every `ROW` that `rows` (stored) has, and for about one in eight of the others.

    The hashes of these rows set bits in bitmaps, which go to every task. What is marked by chance is left out by
    a join with `rows` itself; but that join moves only the marked rows, not the whole texts of all. The bitmaps
    are bounded: of far more rows than they are made for, they mark more of the others, and never miss a row.
    """
    bitmaps = min(MOST_BITMAPS, max(1, math.ceil(rows.count() * MARK_BITS / BITMAP)))
    piece = F.pmod(F.xxhash64(ROW), F.lit(bitmaps)).cast("int")
    bit = F.pmod(F.shiftrightunsigned(F.xxhash64(ROW), 32), F.lit(BITMAP))
    bits = rows.select(piece.alias("__piece"), bit.alias("__bit")).groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = frame.withColumn("__piece", piece).join(F.broadcast(bits), "__piece", "left")
    return met.withColumn(MARK, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))).drop("__piece", "__bits")


def packed(docs: DataFrame) -> DataFrame:
    """One column `row` with all columns of `docs`, so that no name of an operator's own can meet one of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(frame: DataFrame) -> DataFrame:
    """The columns as they came to `packed`."""
    return frame.select("row.*")


def parts_of(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Stretches of a batch whose sizes add up to `most` or less, or hold one item."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))
