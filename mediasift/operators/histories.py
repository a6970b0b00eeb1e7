"""Histories under a machine that refuses: which events a task accepts, for tasks of any size.

A refused event changes nothing, so whether an event is legal depends on all that were accepted before it.
The machine is finite: status and stage, whether a route is bound and whether the queue time is set. What a
stretch of events does is therefore a map from states to states, and maps of consecutive stretches compose.
Events are range-partitioned by task and sequence; a partition that begins inside a task does not know the
state it begins in, and answers for every one: bit s of an event's mask says whether it is accepted from s.
One row for each partition then says where the next begins. No task is gathered, and no window is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift import vocab
from mediasift.sources.shared import stored

TRANSITION, BIND_ROUTE, ENQUEUE = "transition", "bind_route", "enqueue"

State = tuple[str, str, bool, bool]
_START: State = ("none", "none", False, False)
_TARGETS = (vocab.INITIAL_STATE, *dict.fromkeys((s, g) for _, _, s, g in vocab.ALLOWED_TRANSITIONS))
_MOVES = {(vocab.INITIAL_STATE, "none", "none"), *(((s, g), a, b) for a, b, s, g in vocab.ALLOWED_TRANSITIONS)}
#: Symbols: a change to each known state, binding the right route, setting the queue time, and what is never accepted.
SYMBOLS = (*(f"{s}/{g}" for s, g in _TARGETS), BIND_ROUTE, ENQUEUE, "never")


def _next(state: State, symbol: int) -> State | None:
    """The state that an accepted event leads to; None where it is refused."""
    status, stage, bound, queued = state
    if symbol < len(_TARGETS):
        if (_TARGETS[symbol], status, stage) not in _MOVES:
            return None
        if _TARGETS[symbol][1] == "preprocessing" and not queued:  # a task is claimed from the queue
            return None
        return (*_TARGETS[symbol], bound, queued)
    if SYMBOLS[symbol] == BIND_ROUTE and stage == "routing" and not bound:
        return (status, stage, True, queued)
    if SYMBOLS[symbol] == ENQUEUE and stage == "queued" and not queued:
        return (status, stage, bound, True)
    return None


def _machine() -> tuple[list[State], list[list[int]], list[list[bool]]]:
    """All reachable states, the start first; of each symbol its map over them, and where it is accepted."""
    states, at = [_START], 0
    while at < len(states):
        for symbol in range(len(SYMBOLS)):
            to = _next(states[at], symbol)
            if to is not None and to not in states:
                states.append(to)
        at += 1
    to = [[_next(s, symbol) for s in states] for symbol in range(len(SYMBOLS))]
    return states, [[states.index(t) if t else i for i, t in enumerate(row)] for row in to], [[t is not None for t in row] for row in to]


STATES, MAPS, ACCEPTS = _machine()  # fewer than 63 states, so that a mask is a long


def symbol_of(
    op: Column, status: Column, stage: Column, *, started: Column, finished: Column, route: Column, media_type: Column
) -> Column:
    """Number of an event's symbol.

    A change of state carries the start time exactly when it goes to preprocessing, and the end time exactly
    when it goes to finished; a route is bound to the media type of the validated file.
    """
    never = F.lit(len(SYMBOLS) - 1)
    stamped = (started.isNotNull() == (stage == "preprocessing")) & (finished.isNotNull() == (stage == "finished"))
    target = F.when(F.lit(False), never)
    for number, (s, g) in enumerate(_TARGETS):
        target = target.when((status == s) & (stage == g), number)
    out = (
        F.when((op == TRANSITION) & stamped, F.coalesce(target, never))
        .when((op == BIND_ROUTE) & (route == media_type), SYMBOLS.index(BIND_ROUTE))
        .when(op == ENQUEUE, SYMBOLS.index(ENQUEUE))
    )
    return F.coalesce(out, never).cast("int")


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each event with its mask; one last row says what the partition does to the task that it ends in."""
    part = TaskContext.get().partitionId()
    identity = list(range(len(STATES)))
    first = last = None
    states: list[int] = []  # by entry state while the first task lasts, else one
    columns = None
    for batch in batches:
        columns = batch.columns
        masks = []
        for task, symbol in zip(batch["analysis_id"].tolist(), batch["symbol"].tolist(), strict=True):
            if task != last:
                states = identity if first is None else [0]
                first, last = (task if first is None else first), task
            accepts, to = ACCEPTS[symbol], MAPS[symbol]
            if len(states) == 1:
                masks.append(-1 if accepts[states[0]] else 0)
            else:
                masks.append(sum(1 << i for i, s in enumerate(states) if accepts[s]))
            states = [to[s] for s in states]
        yield batch.assign(part=part, mask=masks, first=None, leaves=None)
    if columns is not None:
        leaves = states if len(states) > 1 else states * len(STATES)
        end = {c: [None] for c in columns} | {"analysis_id": [last], "part": [part], "mask": [None], "first": [first], "leaves": [leaves]}
        yield pd.DataFrame(end)


def _entries(ends: list) -> list[tuple[int, int]]:
    """The state that each partition begins in: the start, unless the one before ends in the same task."""
    out, task, state = [], None, 0
    for part, first, last, leaves in sorted(ends):
        entry = state if first == task else 0
        out.append((part, entry))
        task, state = last, leaves[entry]
    return out


def judged(events: DataFrame, order: str = "seq") -> DataFrame:
    """Each event (analysis_id, symbol, `order`, ...) with `accepted`: does the machine take it where it stands?

    `order` is unique in a task. Events without a task are left out. The ranged rows are stored once, as the
    bounds of partitions are sampled and the answers of two runs must not be mixed.
    """
    spark, names = events.sparkSession, events.columns
    named = events.where("analysis_id is not null").withColumn("analysis_id", F.col("analysis_id").cast("string"))
    ranged = named.repartitionByRange("analysis_id", order).sortWithinPartitions("analysis_id", order)
    own = [T.StructField(f.name, f.dataType) for f in ranged.schema.fields]
    own += [T.StructField("part", T.IntegerType()), T.StructField("mask", T.LongType())]
    own += [T.StructField("first", T.StringType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))]
    rows = stored(ranged.mapInPandas(_answers, T.StructType(own)), "histories")
    ends = rows.where("leaves is not null").select("part", "first", "analysis_id", "leaves").collect()  # one a partition
    entries = spark.createDataFrame(_entries([tuple(r) for r in ends]), "part int, entry int")
    answered = rows.where("mask is not null").join(F.broadcast(entries), "part")
    accepted = F.expr("shiftright(mask, entry)").bitwiseAND(F.lit(1).cast("long")) == 1
    return answered.withColumn("accepted", accepted).select(*names, "accepted")


def last_states(judged_events: DataFrame, order: str = "seq") -> DataFrame:
    """Per task: the state after all its events, when its route was bound and its queue time set, and what was refused."""
    taken = F.col("accepted")
    moved = taken & (F.col("op") == TRANSITION)
    return judged_events.groupBy("analysis_id").agg(
        F.max_by(F.when(moved, F.struct("status", "stage")), F.when(moved, F.col(order))).alias("state"),
        F.max(F.when(taken & (F.col("op") == BIND_ROUTE), F.col(order))).alias("bound_at"),
        F.max(F.when(taken & (F.col("op") == ENQUEUE), F.col(order))).alias("queued_at"),
        F.count_if(~taken).alias("n_refused"),
        F.min(F.when(~taken, F.col(order))).alias("first_refused"),
    )
