"""One task across its record tables: do task, source and validation tell the same story (E07, R28)?

The three tables become one tagged union, and each id is judged from one aggregate of it: for every kind of
record the number of rows and the least and greatest record. These combine before the one shuffle and in
any order, so an id with very many rows costs no more than another, and no table is joined to another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("task", "source", "validation")


def _tagged(df: DataFrame, kind: str, record: Column, nothing: dict[str, Column]) -> DataFrame:
    slots = {**nothing, kind: record}
    return df.select("analysis_id", *[slots[k].alias(k) for k in KINDS])


def agreement(tasks: DataFrame, sources: DataFrame, validations: DataFrame) -> DataFrame:
    """For every id in any table, its number of rows of each kind and `first_disagreement`, null if there is none.

    `tasks` has analysis_id, media_type and the struct `validated_file`; `sources` has analysis_id;
    `validations` has analysis_id, accepted and a struct `validated_file` of the same type, or null. Other
    columns are not read. In the order asked: `no_id`, `no_task`, `no_source`, `no_validation`,
    `several_tasks`, `several_validations` (rows that differ; rows repeated in full count as one),
    `not_accepted` (also where that is null), `no_descriptor`, `descriptor:<field>` with the first field that
    differs (null equals null only), `media_type`. Empty tables give no ids of their own.
    """
    descriptor = tasks.schema["validated_file"].dataType
    fields = descriptor.fieldNames()
    file_type = descriptor.simpleString()
    nothing = {
        "task": F.lit(None).cast(f"struct<media_type:string,file:{file_type}>"),
        "source": F.lit(None).cast("boolean"),
        "validation": F.lit(None).cast(f"struct<accepted:boolean,file:{file_type}>"),
    }
    task = F.struct(F.col("media_type"), F.col("validated_file").alias("file"))
    validation = F.struct(F.col("accepted"), F.col("validated_file").alias("file"))
    records = reduce(
        DataFrame.unionAll,
        [
            _tagged(tasks, "task", task, nothing),
            _tagged(sources, "source", F.lit(True), nothing),
            _tagged(validations, "validation", validation, nothing),
        ],
    )
    state = [f(k).alias(f"{name}_{k}") for k in KINDS for name, f in (("n", F.count), ("least", F.min), ("most", F.max))]
    by_id = records.groupBy("analysis_id").agg(*state)

    lone = {k: F.col(f"least_{k}").eqNullSafe(F.col(f"most_{k}")) for k in KINDS}
    t, v = F.col("least_task"), F.col("least_validation")
    questions = [
        ("no_id", F.col("analysis_id").isNull()),
        *[(f"no_{k}", F.col(f"n_{k}") == 0) for k in KINDS],
        ("several_tasks", ~lone["task"]),
        ("several_validations", ~lone["validation"]),
        ("not_accepted", ~F.coalesce(v["accepted"], F.lit(False))),
        ("no_descriptor", v["file"].isNull() | t["file"].isNull()),
        *[(f"descriptor:{f}", ~t["file"][f].eqNullSafe(v["file"][f])) for f in fields],
        ("media_type", ~t["media_type"].eqNullSafe(t["file"]["media_type"])),
    ]
    first = F.coalesce(*[F.when(wrong, F.lit(name)) for name, wrong in questions])
    counts = [F.col(f"n_{k}").alias(f"n_{k}s") for k in KINDS]
    return by_id.select("analysis_id", *counts, first.alias("first_disagreement"))


def agreeing(judged: DataFrame) -> DataFrame:
    """Ids that a task may be made from."""
    return judged.where(F.col("first_disagreement").isNull()).select("analysis_id")
