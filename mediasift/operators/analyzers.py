"""Analyzer plug-ins as batch functions inside Spark tasks."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift import schemas
from mediasift.operators import grids
from mediasift.params import Params
from mediasift.sources import dims


@dataclass(frozen=True)
class Analyzer:
    """A plug-in: `analyze` gets a batch of request rows and returns, for each of them in order,
    score, score_name, summary, raw_metrics (JSON) and candidate_findings (list of JSON).
    `check_applicability` tells, for each row of a batch, whether this version can judge it; rows it
    declines are never handed to `analyze`."""

    analyzer_id: str
    version: str
    media_type: str
    group: str
    analyze: Callable[[pd.DataFrame], pd.DataFrame]
    check_applicability: Callable[[pd.DataFrame], Sequence[bool]] | None = None


class Overdue(BaseException):
    """A plug-in passed its time limit; not an `Exception`, so that no plug-in swallows it."""


def _within(seconds: float, call: Callable[[], pd.DataFrame]) -> pd.DataFrame:
    """The result of `call`, which is interrupted after `seconds` by the timer of its process."""

    def late(*_) -> None:
        raise Overdue

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return call()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


_OUT = ["score", "score_name", "summary", "raw_metrics", "candidate_findings"]


def planned(media: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per file and analyzer of its media type (M04, planning half).

    catalog: analyzer_id, analyzer_version, media_type, group, enabled, min_seconds. A file shorter
    than `min_seconds` is outside an analyzer's scope.
    """
    rows = media.join(dims.broadcast_if_small(catalog), "media_type")
    applicable = F.col("min_seconds").isNull() | (
        F.coalesce("duration_seconds", F.lit(0.0)) >= F.col("min_seconds")
    )
    return rows.withColumns(
        {
            "applicable": applicable,
            "planned_status": F.when(~applicable, "not_applicable").when(
                ~F.col("enabled"), "skipped"
            ),
        }
    )


def complete_plan(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Planned rows with the status of their run, or why there was none.

    A row that should have run and left no result is a timeout.
    """
    key = ["analysis_id", "analyzer_id"]
    done = executed.select(*key, F.col("status").alias("run_status"))
    return plan.join(done, key, "left").withColumn(
        "status", F.coalesce("planned_status", "run_status", F.lit("timeout"))
    ).drop("run_status", "planned_status")


def requests(validated: DataFrame, catalog: DataFrame, params: Params | None = None) -> DataFrame:
    """What each analyzer is given (M05): the descriptor, how many artifacts are prepared for it, its time
    limit and its own settings. No source, no credentials, no paths.

    validated: analysis_id, media_type, duration_seconds, has_audio, size_bytes, sha256.
    """
    params = params or Params()
    return planned(validated, catalog).where(F.col("planned_status").isNull()).select(
        "analysis_id", "media_type", "analyzer_id", "analyzer_version", "group",
        "duration_seconds", "size_bytes", "sha256",
        grids.artifact_count(params).alias("n_artifacts"),
        F.lit(params.analyzer_timeout_seconds).alias("limit_seconds"),
        "settings",
    )


def request_artifacts(validated: DataFrame, catalog: DataFrame, params: Params | None = None) -> DataFrame:
    """The artifacts of each request as rows, made from the file's own row without a join."""
    return planned(validated, catalog).where(F.col("planned_status").isNull()).select(
        "analysis_id", "analyzer_id", "analyzer_version", F.inline(grids.artifacts(params))
    )


def run(request_rows: DataFrame, registry: Mapping[str, Analyzer]) -> DataFrame:
    """Run plug-ins over request rows, batch by batch, without a shuffle.

    A batch that fails is retried row by row; a row that fails becomes an `error` row with a safe
    code and no exception text, and the others are unaffected. A request for an analyzer, or a version
    of one, that the registry lacks is an `error` row too. A call may last as long as the greatest
    `limit_seconds` of its rows (the default of `Params` where there is none); a batch that does not end
    in time is retried row by row, and a row that does not is a `timeout` row, so a plug-in that hangs costs
    its own rows only. The timer interrupts Python code, and native code when it returns to Python. Rows that
    the plug-in declines are `not_applicable`.
    """
    plugins = {(p.analyzer_id, p.version): p for p in registry.values()}
    usual = float(Params().analyzer_timeout_seconds)

    def without_result(n: int, status: str, summary: str, code: str | None) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "score": [None] * n,
                "score_name": [None] * n,
                "summary": [summary] * n,
                "raw_metrics": ["{}"] * n,
                "candidate_findings": [[] for _ in range(n)],
                "status": [status] * n,
                "error_code": [code] * n,
            }
        )

    def failed(n: int) -> pd.DataFrame:
        return without_result(n, "error", "The analyzer failed.", "analyzer_failed")

    def one_call(plugin: Analyzer, rows: pd.DataFrame) -> pd.DataFrame:
        fits = [True] * len(rows)
        if plugin.check_applicability is not None:
            fits = [bool(x) for x in plugin.check_applicability(rows)]
        if len(fits) != len(rows):
            raise ValueError("an analyzer must decide on every request")
        chosen = [i for i, fit in enumerate(fits) if fit]
        declined = without_result(len(rows) - len(chosen), "not_applicable", "The analyzer does not apply.", None)
        if not chosen:
            return declined
        out = plugin.analyze(rows.iloc[chosen]).reset_index(drop=True)
        if len(out) != len(chosen):
            raise ValueError("an analyzer must return one row per request")
        out = out.reindex(columns=_OUT).assign(status="completed", error_code=None)
        if len(chosen) == len(rows):
            return out
        out.index, declined.index = chosen, [i for i, fit in enumerate(fits) if not fit]
        return pd.concat([out.astype(object), declined.astype(object)]).sort_index()

    def limit_of(rows: pd.DataFrame) -> float:
        if "limit_seconds" not in rows:
            return usual
        return float(rows["limit_seconds"].astype("float64").fillna(usual).max())

    def guarded(plugin: Analyzer | None, rows: pd.DataFrame) -> pd.DataFrame:
        if plugin is None:
            return failed(len(rows))
        try:
            return _within(limit_of(rows), lambda: one_call(plugin, rows))
        except Overdue:
            if len(rows) == 1:
                return without_result(1, "timeout", "The analyzer did not end in time.", "analyzer_timeout")
        except Exception:
            if len(rows) == 1:
                return failed(1)
        singles = [guarded(plugin, rows.iloc[i : i + 1]) for i in range(len(rows))]
        return pd.DataFrame([r for s in singles for r in s.to_dict("records")])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, rows in batch.groupby(["analyzer_id", "analyzer_version"], sort=False, dropna=False):
                out = guarded(plugins.get(asked), rows)
                keys = rows.reset_index(drop=True)
                yield pd.DataFrame(
                    {
                        "analysis_id": keys["analysis_id"],
                        "analyzer_id": keys["analyzer_id"],
                        "analyzer_version": keys["analyzer_version"],
                        "media_type": keys["media_type"],
                        "group": keys["group"],
                        "status": out["status"],
                        "applicable": out["status"] != "not_applicable",
                        "score": out["score"].astype("float64"),
                        "score_name": out["score_name"],
                        "summary": out["summary"],
                        "raw_metrics": out["raw_metrics"],
                        "candidate_findings": out["candidate_findings"],
                        "warnings": [[] for _ in range(len(keys))],
                        "error_code": out["error_code"],
                    }
                )

    return request_rows.mapInPandas(task, schemas.ANALYZER_ROW)
