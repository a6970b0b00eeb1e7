"""Lifecycle events as a stream: histories judged as they arrive, duplicate suppression, expiry.

The state of a task is the stretch of its history that a later event can still change, and nothing else:
events older than the watermark are settled, and only the last of them is kept, as the predecessor of what
follows. A trigger reads and writes the tasks that it has events of. An event that arrives out of order is
judged in its place, and verdicts that it changes are given again with a higher revision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mediasift import schemas, vocab
from mediasift.operators.lifecycle import NONE
from mediasift.streaming.run import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STEPS = frozenset({(NONE, NONE, *vocab.INITIAL_STATE), *vocab.ALLOWED_TRANSITIONS})
KEPT = "struct<seq: bigint, at: bigint, status: string, stage: string, prev_status: string, prev_stage: string>"
STATE = f"revision bigint, settled boolean, timer bigint, events array<{KEPT}>"
REVISED = f"{schemas.TRANSITION_VERDICT}, expired boolean, revision bigint"


class Event(NamedTuple):
    """An event of one task; `prev` is what it was judged against, `expired` that the task was silent after it."""

    seq: int
    at: int
    status: str | None
    stage: str | None
    prev: tuple[str, str] = (NONE, NONE)
    expired: bool = False

    @property
    def legal(self) -> bool:
        return (*self.prev, self.status, self.stage) in STEPS


@dataclass(frozen=True)
class History:
    """What is kept of a task: events in sequence order, the first of which may be settled."""

    events: tuple[Event, ...] = ()
    settled: bool = False

    def advance(self, arrived: Iterable[Event], ttl: int | None) -> tuple[History, list[Event], list[Event]]:
        """The history with `arrived` in their places, the events judged anew, and those that came too late.

        An event that is here already changes nothing. One with the number of another event, or before the
        settled one, is late and takes no place. Silence of more than `ttl` microseconds ends a history: the
        event before it has expired, and the next begins anew.
        """
        places = {e.seq: e for e in self.events}
        floor = self.events[0].seq if self.settled else None
        late = []
        for e in sorted(arrived, key=lambda e: (e[0], e[1], str(e[2]), str(e[3]))):
            here = places.get(e.seq)
            if here is None and (floor is None or e.seq > floor):
                places[e.seq] = e
            elif here is None or (here.status, here.stage) != (e.status, e.stage):
                late.append(e)
        before = {e.seq: e for e in self.events}
        order = sorted(places)
        rows: list[Event] = []
        prev, silent = (NONE, NONE), False
        for place, seq in enumerate(order):  # each event is built once: a history may have very many
            _, at, status, stage, kept, _ = places[seq]
            after = ttl is not None and place + 1 < len(order) and places[order[place + 1]].at - at > ttl
            if silent:
                prev = (NONE, NONE)
            rows.append(Event(seq, at, status, stage, kept if not place and self.settled else prev, after))
            prev, silent = (status or "", stage or ""), after
        return History(tuple(rows), self.settled), [e for e in rows if before.get(e.seq) != e], late

    def settle(self, horizon: int) -> History:
        """Without the events that nothing at or after `horizon` can follow directly."""
        n = 0
        while n < len(self.events) and self.events[n].at < horizon:
            n += 1
        return History(self.events[n - 1 :], True) if n else self

    def expire(self) -> Event:
        return self.events[-1]._replace(expired=True)


class _Judge(StatefulProcessor):
    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("history", STATE)

    def _rows(self, key, judged: list[Event], late: list[Event], revision: int) -> pd.DataFrame:
        seq, _, status, stage, prev, expired = zip(*judged, *late, strict=True)
        judged_too = lambda values: [*values, *[None] * len(late)]
        return pd.DataFrame(
            {
                "analysis_id": key[0],
                "seq": seq,
                "status": status,
                "stage": stage,
                "prev_status": judged_too(p[0] for p in prev[: len(judged)]),
                "prev_stage": judged_too(p[1] for p in prev[: len(judged)]),
                "legal": judged_too(e.legal for e in judged),
                "late": [False] * len(judged) + [True] * len(late),
                "expired": expired,
                "revision": revision,
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [Event(*r) for part in rows for r in zip(*[part[c].tolist() for c in ("seq", "at", "status", "stage")], strict=True)]
        history, revision, timer = History(), 0, None
        if self.kept.exists():
            revision, settled, timer, events = self.kept.get()
            history = History(tuple(Event(*e[:4], prev=(e[4], e[5])) for e in events), settled)
        if timer is not None:
            self.handle.deleteTimer(timer)
        # `expired` of what is kept is false but for the last event, which an event after it revises
        history, judged, late = history.advance(arrived, self.ttl)
        history = history.settle(timerValues.getCurrentWatermarkInMs() * 1000)
        timer = None
        if self.ttl is not None:
            timer = (max(e.at for e in history.events) + self.ttl) // 1000 + 1
            self.handle.registerTimer(timer)
        kept = [(e.seq, e.at, e.status, e.stage, *e.prev) for e in history.events]
        self.kept.update((revision + 1, history.settled, timer, kept))
        if judged or late:
            yield self._rows(key, judged, late, revision + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            revision, settled, _, events = self.kept.get()
            last = History(tuple(Event(*e[:4], prev=(e[4], e[5])) for e in events), settled).expire()
            self.kept.clear()
            yield self._rows(key, [last], [], revision + 1)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State lives in the RocksDB provider, on local disk and, as a log of changes, in the shared checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def verdicts(events: DataFrame, *, delay: str = "1 day", ttl_minutes: int | None = None) -> DataFrame:
    """Verdicts of a stream of events (analysis_id, seq, ts, status, stage), with corrections.

    An event may come up to `delay` after later ones. Those that come later still are dropped by the
    watermark; `unjudged` finds them. With `ttl_minutes` a task that has been silent for so long, by event
    time, is forgotten by a timer, and its last verdict is given again as `expired`.
    """
    use_rocksdb(events.sparkSession)
    timed = events.where("analysis_id is not null and seq is not null and ts is not null").withWatermark("ts", delay)
    rows = timed.select("analysis_id", "seq", "ts", F.unix_micros("ts").alias("at"), "status", "stage")
    ttl = None if ttl_minutes is None else ttl_minutes * 60_000_000
    return rows.groupBy("analysis_id").transformWithStateInPandas(
        statefulProcessor=_Judge(ttl), outputStructType=REVISED, outputMode="append", timeMode="eventTime"
    )


def latest_verdicts(revised: DataFrame) -> DataFrame:
    """The last verdict on each event, as an aggregate that combines before its shuffle."""
    key = ["analysis_id", "seq", "status", "stage"]
    rest = ["prev_status", "prev_stage", "legal", "late", "expired"]
    last = F.max_by(F.struct(*rest), "revision").alias("v")
    return revised.groupBy(*key).agg(last).select(*key, *[f"v.{c}" for c in rest])


def run_transitions(
    events: DataFrame, folder: str | None = None, *, delay: str = "1 day", ttl_minutes: int | None = None
) -> DataFrame:
    """Judge what is available now; the last verdict on each event as a table.

    Verdicts, state and progress lie in `folder`, which all executors share; a later call with the same
    folder goes on where this one ended. The verdicts are those of the batch operator, however the events
    are spread over files and triggers, as long as none is later than `delay`.
    """
    spark = events.sparkSession
    folder = folder or shared_folder(spark, "transitions")
    running = (
        verdicts(events, delay=delay, ttl_minutes=ttl_minutes)
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return latest_verdicts(spark.read.schema(REVISED).parquet(f"{folder}/rows"))


def unjudged(events: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of `events`, as a table, that have no verdict: they came after the watermark."""
    return events.join(judged, ["analysis_id", "seq", "status", "stage"], "left_anti")


def first_arrivals(events: DataFrame, *, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row per id within the watermark delay (L03). The delay bounds the state."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["analysis_id"])


def event_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Lifecycle events from a directory of Parquet files."""
    return (
        spark.readStream.schema(schemas.LIFECYCLE_EVENT)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
        .where(F.col("analysis_id").isNotNull())
    )
