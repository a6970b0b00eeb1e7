"""Ordered questions over keys of any size: previous row and position.

A window over a key puts the whole key into one task. Both operators here split a key into
bounded pieces first, answer inside the pieces, and carry the small remainder across.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mediasift.sources.shared import shared_root, stored


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, or one below the warehouse where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return sc.getCheckpointDir()


def with_previous(
    df: DataFrame, key: str, order: str, chunk: Column, values: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Adds the `values` of the preceding row of the same key.

    `chunk` must not decrease with `order` and bounds how many rows of one key share a task.
    The last row of each chunk becomes one extra row at the head of the next chunk of that key, so
    that a window over (key, chunk) sees it. Finding those rows is an aggregate that combines before
    its shuffle; the rows themselves are shuffled once and joined with nothing.
    """
    rows = df.withColumn("_chunk", chunk)
    packed = F.struct(*values)
    lasts = rows.groupBy(key, "_chunk").agg(F.max_by(packed, order).alias("_last"))
    across = W.partitionBy(key).orderBy("_chunk")
    heads = (
        lasts.select(key, F.lead("_chunk").over(across).alias("_chunk"), "_last")
        .where("_chunk IS NOT NULL")
        .select(key, "_chunk", *[F.col("_last")[v].alias(v) for v in values], F.lit(True).alias("_head"))
    )
    inside = W.partitionBy(key, "_chunk").orderBy(F.desc_nulls_last("_head"), order)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn("_before", F.lag(packed).over(inside))
        .where("_head IS NULL")
        .withColumns({f"{prefix}{v}": F.col("_before")[v] for v in values})
        .drop("_chunk", "_head", "_before")
    )


def _shifted(key: str, values: Sequence[str], prefix: str):
    """Work of a task over sorted rows: the values of the row before; a last row tells what the task ends with."""

    def shift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, first, columns = TaskContext.get().partitionId(), None, True, None
        for rows in batches:
            if not len(rows):
                continue
            columns = rows.columns
            lead = rows[[key, *values]].shift(1).astype(object)
            if before is not None:
                lead.iloc[0] = before
            same = lead[key].eq(rows[key])
            found = {f"{prefix}{v}": lead[v].where(same, None) for v in values}
            head = pd.Series(False, index=rows.index)
            head.iloc[0], first = first, False
            before = rows[[key, *values]].iloc[-1].tolist()
            yield rows.assign(**found, _part=part, _head=head, _end=False)
        if columns is not None:
            end = {c: [None] for c in columns} | {key: [before[0]]}
            yield pd.DataFrame(end | {f"{prefix}{v}": [b] for v, b in zip(values, before[1:], strict=True)} | {"_part": [part], "_head": [False], "_end": [True]})

    return shift


def with_previous_ranged(
    df: DataFrame, key: str, order: str, values: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Adds the `values` of the preceding row of the same key, where nothing bounds the rows of a key.

    Rows are range-partitioned by key and order, so a key may span any number of tasks, and each row looks
    at the one before it. The first row of a partition finds it at the end of the partition before, of
    which there is one row each. The ranged rows are stored once, because their bounds are sampled. Rows
    without a key are left out.
    """
    spark, names = df.sparkSession, df.columns
    ranged = df.where(F.col(key).isNotNull()).repartitionByRange(key, order).sortWithinPartitions(key, order)
    schema = T.StructType(list(df.schema.fields))
    for v in values:
        schema = schema.add(f"{prefix}{v}", df.schema[v].dataType)
    schema = schema.add("_part", T.IntegerType()).add("_head", T.BooleanType()).add("_end", T.BooleanType())
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    rows = stored(ranged.mapInPandas(_shifted(key, values, prefix), nullable), "previous")
    looked = [f"{prefix}{v}" for v in values]
    ends = sorted(rows.where("_end").select("_part", key, *looked).collect())  # one a partition
    seams = [(after["_part"], *end[1:]) for end, after in zip(ends, ends[1:], strict=False)]
    fields = [T.StructField("_part", T.IntegerType()), T.StructField("_key", df.schema[key].dataType)]
    fields += [T.StructField(f"_{c}", nullable[c].dataType) for c in looked]
    seam = F.broadcast(spark.createDataFrame(seams, T.StructType(fields)))
    joined = rows.where("not _end").join(seam, "_part", "left")
    at_seam = F.col("_head") & (F.col("_key") == F.col(key))
    return joined.select(*names, *[F.when(at_seam, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in looked])


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], pieces: Sequence[Column], name: str
) -> DataFrame:
    """Adds the 1-based position of each row inside its group, for groups of any size.

    `pieces` cut the order ever finer: none may decrease along `order` within the piece before it, and the
    last bounds how many rows of a group share a task. Rows are counted for each piece, combined before the
    shuffle; at every level the counts of earlier pieces are added up within the piece above, so no window
    holds more than the parts of one piece. All of it is one plan: nothing is sampled, stored or run
    beforehand, and a recomputed task numbers alike. `order` must be unique inside a group. Nulls, in the
    group and in the order, come first.
    """
    levels = [f"_piece{i}" for i in range(len(pieces))]
    rows = df.withColumns(dict(zip(levels, pieces, strict=True)))
    offsets = None
    for depth in range(len(levels), 0, -1):
        inside, level = [*group, *levels[: depth - 1]], levels[depth - 1]
        counts = rows.groupBy(*inside, level).agg(F.count("*").alias("_n"))
        earlier = W.partitionBy(*inside).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        before = counts.select(*inside, level, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        offsets = before if offsets is None else _added(offsets, before, [*inside, level])
    place = F.row_number().over(W.partitionBy(*group, *levels).orderBy(*order))
    numbered = _added(rows.withColumn("_before", place.cast("bigint")), offsets, [*group, *levels])
    return numbered.withColumnRenamed("_before", name).drop(*levels)


def _added(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the offset of their keys added to `_before`; a null key meets null."""
    right = offsets.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("_before").alias("_more"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    joined = rows.join(right, same).withColumn("_before", F.col("_before") + F.col("_more"))
    return joined.drop("_more", *[f"{k}_of" for k in keys])
