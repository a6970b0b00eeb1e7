"""Domain tables derived from the general-purpose test tables.

A view is a base table and layers of SQL expressions that Spark and DuckDB both understand.
The same text builds the Spark DataFrame and the common table expression of the check query, so
that both sides start from equal rows and only the operator under test differs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mediasift import vocab


@dataclass(frozen=True)
class View:
    table: str
    layers: tuple[dict[str, str], ...]
    where: str | None = None
    columns: tuple[str, ...] = field(default=())


def _pick(selector: str, values, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} ELSE {otherwise} END"


def _quoted(values) -> list[str]:
    return [f"'{v}'" for v in values]


_EXTENSIONS = [f[0] for f in vocab.FORMATS]
_MIMES = [f[1] for f in vocab.FORMATS]
_MEDIA = [f[2] for f in vocab.FORMATS]
_SUFFIXES = [f".{e.upper() if i % 2 else e.title()}" for i, e in enumerate(_EXTENSIONS)]
_KINDS = (
    "jpeg", "jpeg", "png", "webp", "wav", "mp3", "flac", "isobmff", "isobmff", "isobmff", "avi", "matroska",
)
_FORMAT_NAMES = (
    "", "", "", "", "wav", "mp3", "flac", "mov,mp4,m4a", "mov,mp4,m4a", "mov,mp4,m4a", "avi", "matroska,webm",
)
_VIDEO_STREAM = (
    "'{\"codec_type\":\"video\",\"codec_name\":\"h264\",\"width\":' || "
    "CASE WHEN doc_id % 43 = 0 THEN 'null' ELSE CAST(320 + doc_id % 64 AS STRING) END || "
    "',\"height\":\"' || CAST(240 + doc_id % 32 AS STRING) || "
    "'\",\"avg_frame_rate\":\"' || "
    + _pick("doc_id % 4", ["'30000/1001'", "'0/0'", "'25'", "'24/1'"])
    + " || '\",\"r_frame_rate\":\"50/2\"}'"
)
_AUDIO_STREAM = (
    "'{\"codec_type\":\"audio\",\"codec_name\":\"aac\",\"sample_rate\":\"' || "
    "CASE WHEN doc_id % 47 = 0 THEN 'n/a' ELSE '44100' END || "
    "'\",\"channels\":' || CAST(1 + doc_id % 2 AS STRING) || "
    "',\"bit_rate\":\"' || CAST(64000 + doc_id AS STRING) || '\"}'"
)
_COVER = "'{\"codec_type\":\"video\",\"codec_name\":\"mjpeg\",\"disposition\":{\"attached_pic\":1}}'"

# Leading bytes per detected format, as hex text; the document text follows as the body.
_HEX = (
    "FFD8FFE0",
    "FFD8FFE1",
    "89504E470D0A1A0A",
    "52494646FFFF000057454250",
    "52494646FFFF000057415645",
    "494433",
    "664C6143",
    "00000018667479704D3441200000020069736F6D6D703432",
    "000000086672656500000018667479706973" "6F6D0000020069736F6D6D703431",
    "000000016672656500000000000000140000000000000014667479707174202000000200" "71742020",
    "52494646FFFF000041564920",
    "1A45DFA38B4282886D6174726F736B61",
)
# Variants of every structure that must not be recognised, or only after a longer walk.
_ODD_HEX = (
    "1A45DFA3874282847765626D",
    "1A45DFA3FF4282886D6174726F736B61",
    "1A45DFA3010000000000000B4282886D6174726F736B61",
    "1A45DFA3984287867765626DC3A94282886D6174726F736B614287810A",
    "1A45DFA3964282886D6174726F736B614282886D6174726F736B61",
    "52494646FFFF000058585858",
    "0000000766747970",
    "00000020667479706D70343100000000",
    "0000000C6D6F6F7600000000",
    "41FFE3414243",
    "FFFBAA",
    "1A45DFA3844282857765",
)

VIEWS: dict[str, View] = {
    # media files, declared types, probe documents and decoder status
    "files_v": View(
        "documents",
        (
            {
                "analysis_id": "md5(CAST(doc_id AS STRING))",
                "name_no": "CAST(doc_id % 16 AS INT)",
                "detected_no": (
                    "CAST(CASE WHEN doc_id % 17 = 0 THEN -1 "
                    "WHEN doc_id % 13 = 0 THEN (doc_id % 16 + 5) % 12 "
                    "ELSE doc_id % 16 % 12 END AS INT)"
                ),
                "size_bytes": "CASE WHEN doc_id % 97 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars * 8192 END",
            },
            {
                "header_kind": _pick("detected_no", _quoted(_KINDS)),
                "actual_mime": _pick("detected_no", _quoted(_MIMES)),
                "format_names": "CASE WHEN doc_id % 41 = 0 THEN 'other' ELSE "
                + _pick("detected_no", _quoted(_FORMAT_NAMES))
                + " END",
                "original_name": (
                    "source || CASE WHEN doc_id % 3 = 0 THEN chr(92) ELSE '/' END || 'F.' || "
                    "CAST(doc_id AS STRING) || "
                    + _pick("name_no", _quoted([*_SUFFIXES, ".webm", "/plain", ".txt", "."]))
                ),
                "document_type": (
                    "CASE WHEN detected_no = 11 THEN "
                    "CASE WHEN doc_id % 19 = 0 THEN 'webm' ELSE 'matroska' END END"
                ),
                "read_status": (
                    "CASE WHEN doc_id % 29 = 0 THEN 'rejected' "
                    "WHEN doc_id % 31 = 0 THEN 'system_failure' ELSE 'ok' END"
                ),
            },
            {
                "declared_content_type": (
                    "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN actual_mime "
                    "WHEN 2 THEN ' ' || upper(actual_mime) || ' ; charset=binary' "
                    "WHEN 3 THEN actual_mime || ';q=1' "
                    "ELSE CASE WHEN doc_id % 25 = 4 THEN 'image/unknown' "
                    "WHEN doc_id % 25 = 9 THEN 'not a mime' ELSE actual_mime END END"
                ),
                "probe_status": (
                    "CASE WHEN detected_no < 4 THEN NULL WHEN doc_id % 23 = 0 THEN 'rejected' "
                    "WHEN doc_id % 23 = 1 THEN 'system_failure' ELSE 'ok' END"
                ),
                "probe_json": (
                    "CASE WHEN doc_id % 53 = 0 THEN '[1]' ELSE "
                    "'{\"format\":{\"format_name\":\"' || format_names || '\",\"duration\":\"' || "
                    "CAST(1 + n_chars % 600 AS STRING) || '.5\"},\"streams\":[' || "
                    f"CASE WHEN detected_no >= 8 THEN {_VIDEO_STREAM} ELSE {_COVER} END || "
                    f"CASE WHEN detected_no >= 8 AND doc_id % 7 = 0 THEN '' ELSE ',' || {_AUDIO_STREAM} END || "
                    "']}' END"
                ),
            },
        ),
    ),
    # leading bytes of a file as hex text, whole document text included
    "headers_v": View(
        "documents",
        (
            {
                "prefix": _pick(
                    "CAST(doc_id % 26 AS INT)",
                    _quoted([*_HEX, *_ODD_HEX]),
                    "''",
                ),
            },
            {"header_hex": "prefix || hex(text)"},
        ),
    ),
    # analyzer runs: analysis = user, one run per event
    "analyzer_v": View(
        "events",
        (
            {
                "analysis_id": "CAST(user_id AS STRING)",
                "analyzer_id": "event_type",
                "analyzer_version": "CASE WHEN event_id % 50 = 0 THEN '0.9' ELSE '1.0' END",
                "media_type": _pick("user_id % 3", _quoted(vocab.MEDIA_TYPES)),
                "status": (
                    "CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'timeout' WHEN 2 THEN 'skipped' "
                    "WHEN 3 THEN 'not_applicable' ELSE 'completed' END"
                ),
                "score_name": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'likelihood' END",
                "n_errors": "CASE WHEN event_id % 14 = 0 THEN 0 WHEN event_id % 7 < 2 THEN 1 ELSE 0 END",
                "summary": "CASE WHEN event_id % 6 = 0 THEN '  ' ELSE 'done' END",
                "warning": "CASE WHEN event_id % 4 = 0 THEN 'limited' ELSE ' ' END",
                "run_ms": "event_id % 1000 - 3",
            },
            {"applicable": "status <> 'not_applicable' OR event_id % 70 = 3"},
        ),
    ),
    # findings: severity and correlation group from the event number and its payload
    "finding_v": View(
        "events",
        (
            {"k": "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"},
            {
                "analysis_id": "CAST(user_id AS STRING)",
                # some findings without a group bear the name of another finding's group
                "finding_id": "CASE WHEN k % 3 = 0 AND k % 50 = 0 THEN 'c' || CAST(k % 4 AS STRING) ELSE 'f' || CAST(event_id AS STRING) END",
                "source_analyzer_id": "event_type",
                "source_analyzer_version": "CASE WHEN event_id % 60 = 0 THEN '2.0' ELSE '1.0' END",
                "severity": (
                    "CASE WHEN event_id % 11 = 0 THEN 'critical' WHEN event_id % 11 < 4 THEN 'significant' "
                    "ELSE 'weak' END"
                ),
                "type": "CASE WHEN event_id % 2 = 0 THEN 'splice' ELSE 'resample' END",
                "correlation_group": (
                    "CASE WHEN k % 3 = 0 THEN NULL ELSE 'c' || CAST(k % 4 AS STRING) END"
                ),
                "critical_override_eligible": "event_id % 22 = 0",
            },
        ),
    ),
    # one finding history per order: small scores, so that every risk level occurs
    "order_finding_v": View(
        "lineitem",
        (
            {
                "analysis_id": "CAST(l_orderkey AS STRING)",
                "finding_id": (
                    "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
                    "CAST(l_linenumber AS STRING)"
                ),
                "severity": (
                    "CASE WHEN l_partkey % 11 = 0 THEN 'critical' WHEN l_partkey % 11 < 5 THEN 'significant' "
                    "ELSE 'weak' END"
                ),
                "type": "CASE WHEN l_suppkey % 2 = 0 THEN 'splice' ELSE 'resample' END",
                "correlation_group": (
                    "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'c' || CAST(l_suppkey % 2 AS STRING) END"
                ),
                "critical_override_eligible": "l_partkey % 22 = 0",
            },
        ),
    ),
    "order_analyzer_v": View(
        "lineitem",
        (
            {
                "analysis_id": "CAST(l_orderkey AS STRING)",
                "analyzer_id": "'a' || CAST(l_linenumber AS STRING)",
                "status": (
                    "CASE WHEN l_partkey % 9 = 0 THEN 'error' WHEN l_partkey % 13 = 0 THEN 'timeout' "
                    "WHEN l_partkey % 17 = 0 THEN 'skipped' WHEN l_partkey % 5 = 0 THEN 'not_applicable' "
                    "ELSE 'completed' END"
                ),
            },
            {"applicable": "status <> 'not_applicable'"},
        ),
    ),
    # lifecycle histories, legal and illegal steps mixed
    "state_v": View(
        "events",
        (
            {
                "analysis_id": "CAST(user_id AS STRING)",
                "seq": "event_id",
                "status": _pick(
                    "event_id % 8",
                    _quoted(("queued", "queued", "queued", "running", "completed", "completed", "failed", "failed")),
                ),
                "stage": _pick(
                    "event_id % 8",
                    _quoted(
                        ("registered", "routing", "queued", "preprocessing", "cleanup", "finished", "cleanup", "finished")
                    ),
                ),
                "has_start": "event_id % 8 = 3 AND event_id % 5 <> 0 OR event_id % 40 = 7",
                "has_finish": "event_id % 8 IN (5, 7) AND event_id % 3 <> 0",
                "cleanup_recorded": "event_id % 8 IN (4, 6) OR event_id % 90 = 1",
            },
        ),
    ),
    # many short histories: order = task, line = step
    "task_step_v": View(
        "lineitem",
        (
            {
                "analysis_id": "CAST(l_orderkey AS STRING)",
                "seq": "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey * 100 + l_suppkey % 100",
                "status": _pick(
                    "CAST((l_linenumber - 1 + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) % 7 AS INT)",
                    _quoted(("queued", "queued", "queued", "running", "completed", "completed", "failed")),
                ),
                "stage": _pick(
                    "CAST((l_linenumber - 1 + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) % 7 AS INT)",
                    _quoted(
                        ("registered", "routing", "queued", "preprocessing", "cleanup", "finished", "cleanup")
                    ),
                ),
            },
        ),
    ),
    # what was asked of a task: line = step, with repeated, strayed and wrongly stamped ones
    "task_op_v": View(
        "lineitem",
        (
            {
                "analysis_id": "CAST(l_orderkey AS STRING)",
                "seq": "CAST(l_linenumber AS BIGINT) * 1000000000000 + CAST(l_partkey AS BIGINT) * 1000000 + l_suppkey",
                "step": "CAST((l_linenumber - 1 + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 7 AS INT)",
            },
            {
                "op": _pick("step", _quoted(("transition", "transition", "bind_route", "transition", "enqueue", "transition", "transition"))),
                "status": _pick("step", ("'queued'", "'queued'", "NULL", "'queued'", "NULL", "'running'", "'failed'")),
                "stage": _pick("step", ("'registered'", "'routing'", "NULL", "'queued'", "NULL", "'preprocessing'", "'cleanup'")),
                "started": "step = 5 AND l_partkey % 11 <> 0 OR l_partkey % 53 = 0",
                "finished": "l_partkey % 59 = 0",
                "media_type": "'video'",
                "route": "CASE WHEN step = 2 THEN CASE WHEN l_suppkey % 7 = 0 THEN 'audio' ELSE 'video' END END",
            },
        ),
    ),
    # waiting tasks: one per event
    "queue_v": View(
        "events",
        (
            {
                "analysis_id": "md5(CAST(event_id AS STRING))",
                "media_type": _pick("user_id % 4", _quoted((*vocab.MEDIA_TYPES, "video"))),
                "queued_at": "ts",
                "status": "CASE WHEN event_id % 10 = 9 THEN 'running' ELSE 'queued' END",
                "stage": "CASE WHEN event_id % 10 = 9 THEN 'preprocessing' WHEN event_id % 10 = 8 THEN 'routing' ELSE 'queued' END",
                "route": "CASE WHEN event_id % 15 = 0 THEN 'image' WHEN event_id % 4 = 1 THEN NULL ELSE 'video' END",
            },
        ),
    ),
    # workspace entries: one per event, expiry limits near the end of the event times
    "workspace_v": View(
        "events",
        (
            {
                "analysis_id": (
                    "CASE WHEN event_id % 31 = 0 THEN 'tmp' || CAST(event_id AS STRING) "
                    "WHEN event_id % 37 = 0 THEN upper(md5(CAST(event_id AS STRING))) "
                    "ELSE md5(CAST(event_id AS STRING)) END"
                ),
                "location": "CASE WHEN event_id % 2 = 0 THEN 'workspace' ELSE 'quarantine' END",
                "mtime": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts END",
                "is_symlink": "event_id % 43 = 0",
                "is_dir": "event_id % 47 <> 0",
                "task_stage": "CASE WHEN event_id % 5 = 0 THEN 'finished' WHEN event_id % 5 = 1 THEN 'analysis' END",
            },
        ),
    ),
    # delete attempts: one per order line
    "attempt_v": View(
        "lineitem",
        (
            {
                "analysis_id": "CAST(l_orderkey AS STRING)",
                "artifact_id": "'a' || CAST(l_linenumber AS STRING)",
                "kind": "CASE WHEN l_linenumber = 1 THEN 'original' ELSE 'intermediate' END",
                "ok": "l_suppkey % 4 = 0",
                "deleted": "l_partkey % 5 <> 0",
            },
        ),
    ),
    # stored results, flat
    "result_v": View(
        "orders",
        (
            {
                "analysis_id": "md5(CAST(o_orderkey AS STRING))",
                "created_at": "o_orderdate",
                "status": (
                    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' "
                    "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'failed' END END"
                ),
                "level": (
                    "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' "
                    "WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END"
                ),
                "validated": "o_orderkey % 10 <> 0",
                "media_type": _pick("o_orderkey % 3", _quoted(vocab.MEDIA_TYPES)),
                "completeness": _pick("o_custkey % 4", _quoted(vocab.COMPLETENESS_STATUSES)),
                "n_analyzers": "CAST(o_orderkey % 3 AS INT)",
                "n_findings": "CAST(o_custkey % 2 AS INT)",
                "n_errors": "CAST(o_custkey % 3 AS INT)",
                "explained": "o_custkey % 5 <> 0",
            },
        ),
    ),
    # localizations, numeric fields as exact decimals in JSON text
    "place_v": View(
        "lineitem",
        (
            {
                "row_id": (
                    "CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || "
                    "CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
                ),
                "a": "l_partkey % 120",
                "b": "l_suppkey % 120",
                "kind": _pick("l_linenumber % 4", _quoted(vocab.LOCALIZATION_TYPES)),
            },
            {
                "place_json": (
                    "'{\"type\":\"' || kind || '\"' || CASE kind "
                    "WHEN 'file' THEN CASE WHEN a = 7 THEN ',\"x\":1' ELSE '' END "
                    "WHEN 'bounding_box' THEN ',\"x\":' || CASE WHEN a >= 100 THEN '1.5' ELSE '0' END || "
                    "',\"y\":0,\"width\":1,\"height\":1' || CASE WHEN b = 5 THEN '' "
                    "ELSE ',\"coordinate_space\":\"' || CASE WHEN b = 6 THEN 'pixels' ELSE 'normalized' END || '\"' END "
                    "WHEN 'time_interval' THEN ',\"start_seconds\":' || CAST(a AS STRING) || ',\"end_seconds\":' || CAST(b AS STRING) "
                    "ELSE ',\"start_frame\":' || CAST(a AS STRING) || ',\"end_frame\":' || CAST(b AS STRING) END || "
                    "CASE WHEN a = b THEN ',\"note\":null' ELSE '' END || '}'"
                ),
            },
        ),
    ),
    # received files, and what was declared of them in versions before and after they came
    "received_v": View(
        "documents",
        (
            {
                "path": "'in/' || CAST(doc_id AS STRING) || '.png'",
                "body": "coalesce(text, '')",
                "arrived": "CAST('2031-02-03 04:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00' AS TIMESTAMP)",
            },
        ),
    ),
    "declaration_v": View(
        "lineitem",
        (
            {
                "path": "'in/' || CAST(l_orderkey AS STRING) || '.png'",
                "version": "CAST(l_linenumber AS BIGINT)",
                "declared_at": "CAST('2031-02-03 04:' || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') || ':00' AS TIMESTAMP)",
                "original_name": "'n' || CAST(l_suppkey AS STRING) || '.png'",
                "declared_content_type": _pick("CAST(l_suppkey % 4 AS INT)", ("'image/png'", "' IMAGE/JPEG; q=1'", "NULL", "'?'")),
            },
        ),
    ),
    # the records of a task: one order each, with a known share of damaged ones
    "accepted_v": View(
        "orders",
        (
            {
                "analysis_id": "md5(CAST(o_orderkey AS STRING))",
                "file_media": _pick("CAST(o_custkey % 3 AS INT)", _quoted(vocab.MEDIA_TYPES)),
                "file_name": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'f' || CAST(o_orderkey AS STRING) END",
                "file_bytes": "o_orderkey * 7 + 1",
                "config_snapshot_id": "CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'c1' END",
                "created_at": "CASE o_orderkey % 5 WHEN 0 THEN '2031-02-03T04:05:06+03:00' WHEN 1 THEN '2031-02-03T04:05:06+00:00' "
                "WHEN 2 THEN '2031-02-03T04:05:06' ELSE '2031-02-03T04:05:06Z' END",
                "started_at": "CASE o_orderkey % 7 WHEN 0 THEN '2031-02-03T05:05:06-01:00' WHEN 1 THEN NULL ELSE '2031-02-03T05:05:06Z' END",
            },
            {"media_type": "CASE WHEN o_orderkey % 23 = 0 THEN 'none' ELSE file_media END"},
        ),
    ),
    "held_source_v": View(
        "orders",
        ({"analysis_id": "md5(CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS STRING))"},),
    ),
    "verdict_v": View(
        "orders",
        (
            {
                "analysis_id": "md5(CAST(CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING))",
                "accepted": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderkey % 7 <> 0 END",
                "described": "o_orderkey % 7 <> 0 AND o_orderkey % 31 <> 0",
                "file_media": _pick("CAST((o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) % 3 AS INT)", _quoted(vocab.MEDIA_TYPES)),
                "file_name": "CASE WHEN o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 THEN NULL ELSE 'f' || CAST(o_orderkey AS STRING) END",
                "file_bytes": "o_orderkey * 7 + CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END",
            },
        ),
    ),
    # log records
    "log_v": View(
        "events",
        (
            {
                "level": "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END",
                "logger": "'app.' || event_type",
                "event": (
                    "CASE event_id % 4 WHEN 0 THEN 'result_saved' WHEN 1 THEN 'analyzer_finished' "
                    "WHEN 2 THEN 'unknown_event' ELSE NULL END"
                ),
                "message": "'n=' || CAST(event_id AS STRING)",
                "host": "CASE WHEN event_id % 3 = 0 THEN 'h1' END",
                "port": "CASE WHEN event_id % 3 = 0 THEN CAST(8000 + event_id % 10 AS INT) END",
            },
        ),
    ),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; unused expressions and columns are pruned by the optimizer."""
    return derive(read(spark, sf_dir, VIEWS[name].table), name)


def derive(df: DataFrame, name: str) -> DataFrame:
    """The view over an already opened base table, batch or stream."""
    for layer in VIEWS[name].layers:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
    return df


def cte(*names: str) -> str:
    """`WITH` clause that defines the views for the check query."""
    parts = []
    for name in names:
        v = VIEWS[name]
        sql = f"SELECT * FROM {v.table}"
        for layer in v.layers:
            added = ", ".join(f"{e} AS {n}" for n, e in layer.items())
            sql = f"SELECT *, {added} FROM ({sql})"
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ", ".join(parts)
