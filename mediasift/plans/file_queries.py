"""Queries over media files: names, types, signatures, probes and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import schemas, vocab
from mediasift.functions import jsontypes as J
from mediasift.functions import probe as P
from mediasift.functions import signature as G
from mediasift.functions import text as X
from mediasift.functions.base import with_fields_of
from mediasift.operators import gate
from mediasift.operators import rules as R
from mediasift.plans.intake import rejections_by_source
from mediasift.plans.registry import PARAMS, query
from mediasift.plans.views import cte, read, view
from mediasift.sources import dims, media

# --- files: names, types, limits -----------------------------------------------------------
_EXT = (
    "nullif(lower(regexp_extract(original_name, '[^/\\\\][.]([^./\\\\]+)$', 1)), '')"
)
_MIME = (
    "CASE WHEN regexp_matches(lower(trim(split_part(declared_content_type, ';', 1))), "
    "'^[!#$%&''*+.^_`|~0-9a-z-]+/[!#$%&''*+.^_`|~0-9a-z-]+$') "
    "THEN lower(trim(split_part(declared_content_type, ';', 1))) END"
)
_MATRIX = (
    "(VALUES " + ", ".join(str(f) for f in vocab.FORMATS) + ") AS m(extension, mime, media_type, container)"
)
_LIMIT = (
    "CASE media_type "
    + " ".join(f"WHEN '{m}' THEN {PARAMS.limit_bytes(m)}" for m in vocab.MEDIA_TYPES)
    + " END"
)
FILES = ("files_v",)


@query("ext_extract", f"{cte(*FILES)} SELECT doc_id, {_EXT} AS extension FROM files_v")
def ext_extract(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files_v").select(
        "doc_id", X.file_extension(F.col("original_name")).alias("extension")
    )


@query("mime_norm", f"{cte(*FILES)} SELECT doc_id, {_MIME} AS declared_mime FROM files_v")
def mime_norm(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files_v").select(
        "doc_id", X.normalized_mime(F.col("declared_content_type")).alias("declared_mime")
    )


@query(
    "format_lookup",
    f"{cte(*FILES)}, f AS (SELECT doc_id, {_EXT} AS extension FROM files_v) "
    "SELECT f.doc_id, f.extension, m.mime AS expected_mime, m.media_type, m.container "
    f"FROM f LEFT JOIN {_MATRIX} ON f.extension = m.extension",
)
def format_lookup(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files_v").select(
        "doc_id", X.file_extension(F.col("original_name")).alias("extension")
    )
    matrix = F.broadcast(dims.format_matrix(spark))
    return files.join(matrix, "extension", "left").select(
        "doc_id", "extension", F.col("detected_mime").alias("expected_mime"), "media_type", "container"
    )


@query(
    "size_limit",
    f"{cte(*FILES)}, f AS (SELECT doc_id, size_bytes, {_EXT} AS extension FROM files_v) "
    f"SELECT doc_id, m.media_type, CAST({_LIMIT} AS BIGINT) AS limit_bytes, "
    f"size_bytes <= {_LIMIT} AS fits FROM f JOIN {_MATRIX} ON f.extension = m.extension",
)
def size_limit(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files_v").select(
        "doc_id",
        "size_bytes",
        P.format_field(X.file_extension(F.col("original_name")), "media_type").alias("media_type"),
    )
    limits = F.broadcast(dims.size_limits(spark, PARAMS))
    return files.join(limits, "media_type").select(
        "doc_id", "media_type", "limit_bytes", (F.col("size_bytes") <= F.col("limit_bytes")).alias("fits")
    )


@query(
    "safe_id",
    "WITH w AS (SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN 'con' WHEN 1 THEN 'LPT1.txt' WHEN 2 THEN url "
    "WHEN 3 THEN '..' WHEN 4 THEN 'a' || chr(92) || 'b' WHEN 5 THEN 'nul .x' WHEN 6 THEN '' "
    "WHEN 7 THEN md5(url) ELSE 'console' END AS candidate FROM pages) "
    "SELECT page_id, candidate, page_id % 9 IN (7, 8) AS is_safe, page_id % 9 = 7 AS is_system FROM w",
)
def safe_id(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").selectExpr(
        "page_id",
        "CASE page_id % 9 WHEN 0 THEN 'con' WHEN 1 THEN 'LPT1.txt' WHEN 2 THEN url WHEN 3 THEN '..' "
        "WHEN 4 THEN 'a' || chr(92) || 'b' WHEN 5 THEN 'nul .x' WHEN 6 THEN '' WHEN 7 THEN md5(url) "
        "ELSE 'console' END AS candidate",
    )
    return pages.select(
        "page_id",
        "candidate",
        X.is_safe_id(F.col("candidate")).alias("is_safe"),
        X.is_system_id(F.col("candidate")).alias("is_system"),
    )


@query(
    "artifact_path",
    "WITH p AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'frames/' WHEN 1 THEN '/abs/' WHEN 2 THEN '../' "
    "WHEN 3 THEN 'a//./' WHEN 4 THEN 'nul/' ELSE '' END || role || '.png' AS path FROM conversations) "
    "SELECT conv_id, turn, path, turn % 6 IN (0, 3, 5) AS is_safe FROM p",
)
def artifact_path(spark: SparkSession, sf: str) -> DataFrame:
    paths = read(spark, sf, "conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE turn % 6 WHEN 0 THEN 'frames/' WHEN 1 THEN '/abs/' WHEN 2 THEN '../' WHEN 3 THEN 'a//./' "
        "WHEN 4 THEN 'nul/' ELSE '' END || role || '.png' AS path",
    )
    return paths.select(
        "conv_id", "turn", "path", X.is_safe_artifact(F.lit("key_frame_1"), F.col("path")).alias("is_safe")
    )


@query("sha_hex", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def sha_hex(spark: SparkSession, sf: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    files = read(spark, sf, "documents").select(
        "doc_id", content.alias("content"), F.octet_length(content).cast("bigint").alias("length")
    )
    return media.measure(files, PARAMS).select("doc_id", "sha256", "size_bytes")


@query(
    "fingerprint",
    "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || "
    "',\"n_regionkey\":' || n_regionkey || '}') AS fingerprint FROM nation",
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "nation")
    return df.select("n_nationkey", X.row_fingerprint(df.columns).alias("fingerprint"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS iso FROM events")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", X.iso_utc(F.col("ts")).alias("iso"))


@query(
    "utc_only",
    "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 6 WHEN 0 THEN 'Z' "
    "WHEN 1 THEN '+00:00' WHEN 2 THEN '+03:00' WHEN 3 THEN '' WHEN 4 THEN '.125Z' ELSE '-05:30' END AS t, ts FROM events) "
    "SELECT event_id, event_id % 6 IN (0, 1, 4) AS is_utc FROM e",
)
def utc_only(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
            F.expr(
                "CASE event_id % 6 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' WHEN 2 THEN '+03:00' WHEN 3 THEN '' "
                "WHEN 4 THEN '.125Z' ELSE '-05:30' END"
            ),
        ).alias("t"),
    )
    return texts.select("event_id", X.is_utc_text(F.col("t")).alias("is_utc"))


# --- signatures ------------------------------------------------------------------------------
_KIND_SQL = """
CASE WHEN header_hex LIKE 'FFD8FF%' THEN 'jpeg'
     WHEN header_hex LIKE '89504E470D0A1A0A%' THEN 'png'
     WHEN header_hex LIKE '52494646%' AND length(header_hex) >= 24 THEN
       CASE substr(header_hex, 17, 8) WHEN '57454250' THEN 'webp' WHEN '57415645' THEN 'wav' WHEN '41564920' THEN 'avi' END
     WHEN header_hex LIKE '664C6143%' THEN 'flac'
     WHEN header_hex LIKE '1A45DFA3%' THEN CASE WHEN n IN (11, 12, 14, 15) THEN 'matroska' END
     WHEN header_hex LIKE '494433%' OR (n IN (21, 22) AND length(header_hex) >= 10 + CASE n WHEN 21 THEN 2 ELSE 0 END) THEN 'mp3'
     WHEN n IN (7, 8, 9) THEN 'isobmff'
     WHEN n = 19 AND length(header_hex) >= 64 THEN 'isobmff' END
"""
HEADERS = f"{cte('headers_v')}, h AS (SELECT doc_id, header_hex, doc_id % 26 AS n FROM headers_v)"


@query("magic_class", f"{HEADERS} SELECT doc_id, {_KIND_SQL} AS kind FROM h")
def magic_class(spark: SparkSession, sf: str) -> DataFrame:
    headers = view(spark, sf, "headers_v").select(
        "doc_id", G.header_of(F.unhex("header_hex")).alias("header")
    )
    return headers.select("doc_id", G.classify(F.col("header"))["kind"].alias("kind"))


# each pair of hex digits is one byte; the group before the sync pair keeps the search aligned
@query(
    "mpeg_frame",
    f"{HEADERS} SELECT doc_id, regexp_matches(substr(header_hex, 1, 131072), "
    "'^(?:..)*FF(?:E2|E3|EA|EB|F2|F3|FA|FB)(?:..){3}') AS has_frame FROM h",
)
def mpeg_frame(spark: SparkSession, sf: str) -> DataFrame:
    headers = view(spark, sf, "headers_v").select(
        "doc_id", G.header_of(F.unhex("header_hex")).alias("header")
    )
    return headers.select("doc_id", G.has_mpeg_audio_frame(F.col("header")).alias("has_frame"))


# the box walk as a recursion over (document, offset)
_WALK = f"""
WITH RECURSIVE {cte('headers_v')[5:]},
h AS (SELECT doc_id, substr(header_hex, 1, 131072) AS x FROM headers_v),
walk AS (
  SELECT doc_id, x, CAST(0 AS HUGEINT) AS pos FROM h
  UNION ALL
  SELECT doc_id, x, pos + size FROM (
    SELECT doc_id, x, pos, head, type, size FROM (
      SELECT *, CASE WHEN small = 1 THEN CAST('0x' || substr(x, CAST(2 * pos + 17 AS INT), 16) AS UBIGINT)::HUGEINT ELSE small END AS size
      FROM (SELECT *, CASE WHEN small = 1 THEN 16 ELSE 8 END AS head FROM (
        SELECT doc_id, x, pos, CAST('0x' || substr(x, CAST(2 * pos + 1 AS INT), 8) AS BIGINT)::HUGEINT AS small,
               substr(x, CAST(2 * pos + 9 AS INT), 8) AS type
        FROM walk WHERE 2 * (pos + 8) <= length(x)) WHERE NOT (small = 1 AND 2 * (pos + 16) > length(x)))
    ) WHERE size >= head AND type <> '66747970'
  ) WHERE 2 * (pos + size + 8) <= length(x)
),
last AS (SELECT doc_id, x, max(pos) AS pos FROM walk GROUP BY doc_id, x),
ftyp AS (
  SELECT doc_id, x, pos, CAST('0x' || substr(x, CAST(2 * pos + 1 AS INT), 8) AS BIGINT) AS size FROM last
  WHERE substr(x, CAST(2 * pos + 9 AS INT), 8) = '66747970'
),
good AS (SELECT * FROM ftyp WHERE size >= 16 AND 2 * (pos + size) <= length(x)),
brands AS (
  SELECT doc_id, substr(x, CAST(2 * (pos + 8) + 1 AS INT), 8) AS brand FROM good
  UNION
  SELECT doc_id, substr(x, CAST(2 * (pos + i) + 1 AS INT), 8) FROM (
    SELECT doc_id, x, pos, unnest(range(16, size - 3, 4)) AS i FROM good)
)
SELECT h.doc_id, string_agg(brand, ',' ORDER BY brand) AS brands FROM h LEFT JOIN brands USING (doc_id) GROUP BY h.doc_id
"""


@query("brands", _WALK)
def brands(spark: SparkSession, sf: str) -> DataFrame:
    headers = view(spark, sf, "headers_v").select(
        "doc_id", G.header_of(F.unhex("header_hex")).alias("header")
    )
    return headers.select(
        "doc_id", F.array_join(F.array_sort(G.iso_bmff_brands(F.col("header"))), ",").alias("brands")
    )


@query(
    "doctype",
    f"{HEADERS} SELECT doc_id, CASE WHEN n IN (11, 14, 15) THEN 'matroska' WHEN n = 12 THEN 'webm' END AS document_type FROM h",
)
def doctype(spark: SparkSession, sf: str) -> DataFrame:
    headers = view(spark, sf, "headers_v").select(
        "doc_id", G.header_of(F.unhex("header_hex")).alias("header")
    )
    return headers.select("doc_id", G.ebml_document_type(F.col("header")).alias("document_type"))


# --- probe documents -------------------------------------------------------------------------
_PROBE = f"""{cte(*FILES)}, p AS (
  SELECT doc_id, header_kind, detected_no, document_type, probe_json AS j,
    json_extract_string(probe_json, '$.format.format_name') AS names,
    try_cast(json_extract_string(probe_json, '$.format.duration') AS DOUBLE) AS duration,
    list_filter(json_extract(probe_json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'audio') AS audio,
    list_filter(json_extract(probe_json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'video'
      AND coalesce(json_extract_string(s, '$.disposition.attached_pic'), '0') <> '1') AS video
  FROM files_v WHERE detected_no >= 4)"""


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    return (
        view(spark, sf, "files_v")
        .where("detected_no >= 4")
        .select("doc_id", "header_kind", "detected_no", P.flatten(F.col("probe_json")).alias("probe"))
    )


@query(
    "probe_flatten",
    f"{_PROBE} SELECT doc_id, names IS NOT NULL AS well_formed, "
    "array_to_string(list_sort(string_split(names, ',')), ',') AS format_names, duration AS format_duration, "
    "CASE WHEN names IS NOT NULL THEN CAST(len(audio) AS INT) END AS n_audio, "
    "CASE WHEN names IS NOT NULL THEN CAST(len(video) AS INT) END AS n_video FROM p",
)
def probe_flatten(spark: SparkSession, sf: str) -> DataFrame:
    probe = F.col("probe")
    return _probed(spark, sf).select(
        "doc_id",
        probe.isNotNull().alias("well_formed"),
        F.array_join(F.array_sort(probe["format_names"]), ",").alias("format_names"),
        probe["format_duration"].alias("format_duration"),
        F.size(F.when(probe.isNotNull(), probe["audio"])).alias("n_audio"),
        F.size(F.when(probe.isNotNull(), probe["video"])).alias("n_video"),
    ).withColumns(
        {
            "n_audio": F.when(F.col("well_formed"), F.col("n_audio")),
            "n_video": F.when(F.col("well_formed"), F.col("n_video")),
        }
    )


@query(
    "probe_audio",
    f"{_PROBE}, a AS (SELECT doc_id, duration, audio[1] AS s FROM p) "
    "SELECT doc_id, duration AS duration_seconds, try_cast(json_extract_string(s, '$.sample_rate') AS INT) AS sample_rate_hz, "
    "try_cast(json_extract_string(s, '$.channels') AS INT) AS channels, json_extract_string(s, '$.codec_name') AS codec, "
    "try_cast(json_extract_string(s, '$.bit_rate') AS BIGINT) AS bitrate_bps FROM a "
    "WHERE try_cast(json_extract_string(s, '$.sample_rate') AS INT) > 0",
)
def probe_audio(spark: SparkSession, sf: str) -> DataFrame:
    return (
        with_fields_of(
            _probed(spark, sf), F.struct(P.audio_parameters(F.col("probe")).alias("a")), "doc_id"
        )
        .where("a IS NOT NULL")
        .select("doc_id", "a.*")
    )


_FPS = (
    "CASE json_extract_string({s}, '$.avg_frame_rate') WHEN '30000/1001' THEN 30000.0::DOUBLE / 1001 WHEN '24/1' THEN 24.0::DOUBLE "
    "ELSE 25.0::DOUBLE END"
)


@query(
    "probe_video",
    f"{_PROBE}, v AS (SELECT doc_id, duration, video[1] AS s, audio[1] AS a, len(audio) AS na, detected_no FROM p) "
    "SELECT doc_id, duration AS duration_seconds, CASE detected_no WHEN 8 THEN 'mp4' WHEN 9 THEN 'mov' WHEN 10 THEN 'avi' ELSE 'mkv' END AS container, "
    "json_extract_string(s, '$.codec_name') AS video_codec, json_extract_string(a, '$.codec_name') AS audio_codec, "
    "try_cast(json_extract_string(s, '$.width') AS INT) AS width, try_cast(json_extract_string(s, '$.height') AS INT) AS height, "
    f"{_FPS.format(s='s')} AS fps, try_cast(json_extract_string(s, '$.bit_rate') AS BIGINT) AS bitrate_bps, na > 0 AS has_audio "
    "FROM v WHERE try_cast(json_extract_string(s, '$.width') AS INT) > 0",
)
def probe_video(spark: SparkSession, sf: str) -> DataFrame:
    container = F.expr("CASE detected_no WHEN 8 THEN 'mp4' WHEN 9 THEN 'mov' WHEN 10 THEN 'avi' ELSE 'mkv' END")
    return (
        with_fields_of(
            _probed(spark, sf),
            F.struct(P.video_parameters(F.col("probe"), container).alias("v")),
            "doc_id",
        )
        .where("v IS NOT NULL")
        .select("doc_id", "v.*")
    )


@query(
    "fps",
    f"{_PROBE} SELECT doc_id, {_FPS.format(s='video[1]')} AS fps FROM p WHERE len(video) > 0",
)
def fps(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(F.col("probe.video"), F.lit(0))
    rate = F.coalesce(J.frame_rate(J.member(first, "avg_frame_rate")), J.frame_rate(J.member(first, "r_frame_rate")))
    return _probed(spark, sf).where(P.has_streams(F.col("probe.video"))).select("doc_id", rate.alias("fps"))


_RESOLVED = (
    "CASE WHEN header_kind = 'jpeg' THEN 'jpg' WHEN header_kind IN ('png', 'webp') THEN header_kind "
    "WHEN names IS NULL THEN NULL "
    "WHEN header_kind = 'matroska' THEN CASE WHEN len(video) > 0 THEN 'mkv' END "
    "WHEN names = 'other' THEN NULL WHEN header_kind = 'isobmff' THEN "
    "CASE WHEN len(video) = 0 THEN CASE WHEN len(audio) > 0 THEN 'm4a' END WHEN detected_no = 9 THEN 'mov' ELSE 'mp4' END "
    "ELSE header_kind END"
)


@query("resolve_format", f"{_PROBE} SELECT doc_id, {_RESOLVED} AS detected_extension FROM p")
def resolve_format(spark: SparkSession, sf: str) -> DataFrame:
    quicktime = F.when(F.col("detected_no") == 9, F.array(F.lit("71742020"))).otherwise(
        F.array(F.lit("69736F6D"))
    )
    return _probed(spark, sf).select(
        "doc_id",
        P.resolved_extension(F.col("header_kind"), quicktime, F.col("probe")).alias("detected_extension"),
    )


# --- the gate ----------------------------------------------------------------------------------
GATE_SQL = f"""{cte(*FILES)}, p AS (
  SELECT *, {_EXT} AS ext, {_MIME} AS declared_mime,
    json_extract_string(probe_json, '$.format.format_name') AS names,
    len(list_filter(json_extract(probe_json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'audio')) AS na,
    len(list_filter(json_extract(probe_json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'video'
      AND coalesce(json_extract_string(s, '$.disposition.attached_pic'), '0') <> '1')) AS nv
  FROM files_v),
d AS (SELECT p.*, e.mime AS expected_mime, x.mime AS detected_mime, x.media_type,
    detected_no >= 4 AND document_type IS DISTINCT FROM 'webm' AS probed
  FROM p LEFT JOIN {_MATRIX.replace(' AS m(', ' AS e(')} ON p.ext = e.extension
  LEFT JOIN {_MATRIX.replace(' AS m(', ' AS x(')} ON x.extension = CASE
    WHEN document_type = 'webm' THEN NULL
    WHEN header_kind = 'jpeg' THEN 'jpg' WHEN header_kind IN ('png', 'webp') THEN header_kind
    WHEN probe_status <> 'ok' OR names IS NULL THEN NULL
    WHEN header_kind = 'matroska' THEN CASE WHEN nv > 0 THEN 'mkv' END
    WHEN names = 'other' THEN NULL
    WHEN header_kind = 'isobmff' THEN CASE WHEN nv = 0 THEN CASE WHEN na > 0 THEN 'm4a' END WHEN detected_no = 9 THEN 'mov' ELSE 'mp4' END
    ELSE header_kind END),
g AS (SELECT *,
    CASE WHEN size_bytes > {PARAMS.hard_limit_bytes} THEN 99
      WHEN size_bytes = 0 THEN 1 WHEN ext IS NULL THEN 2 WHEN expected_mime IS NULL THEN 3 WHEN detected_mime IS NULL THEN 4
      WHEN expected_mime <> detected_mime THEN 7
      WHEN declared_content_type IS NOT NULL AND declared_mime IS DISTINCT FROM detected_mime THEN 8
      WHEN size_bytes > {_LIMIT} THEN 9
      WHEN read_status <> 'ok' OR (media_type = 'audio' AND doc_id % 47 = 0) OR (media_type = 'video' AND doc_id % 43 = 0) THEN 10
      ELSE 0 END AS failed_at,
    doc_id % 37 = 0 AS broken
  FROM d),
s AS (SELECT *,
    CASE WHEN failed_at = 99 THEN 'rejected' WHEN broken THEN 'failed'
      WHEN failed_at = 4 AND probed AND (probe_status = 'system_failure' OR (probe_status = 'ok' AND names IS NULL)) THEN 'failed'
      WHEN failed_at = 10 AND read_status = 'system_failure' THEN 'failed'
      WHEN failed_at = 0 THEN 'accepted' ELSE 'rejected' END AS status
  FROM g),
o AS (SELECT *, CASE WHEN status = 'failed' THEN 'internal_error' WHEN status = 'rejected' THEN
    CASE failed_at WHEN 1 THEN 'file_empty' WHEN 2 THEN 'missing_extension' WHEN 3 THEN 'unsupported_extension'
      WHEN 4 THEN CASE WHEN probed AND probe_status = 'rejected' THEN 'unsafe_or_unreadable_file' ELSE 'unsupported_mime_type' END
      WHEN 7 THEN 'file_signature_mismatch' WHEN 8 THEN 'file_signature_mismatch' WHEN 10 THEN 'unsafe_or_unreadable_file'
      ELSE 'file_too_large' END END AS error_code FROM s)"""
_CHECK_NAME = (
    "CASE failed_at " + " ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(vocab.CHECKS)) + " END"
)


def gate_inputs(files: DataFrame, *more: str) -> DataFrame:
    """Gate columns from `files_v`, and `more` of its columns."""
    image = F.struct(
        (F.col("doc_id") % 4096 + 1).cast("int").alias("width"),
        (F.col("doc_id") % 2048 + 1).cast("int").alias("height"),
        F.upper("header_kind").alias("format"),
        F.lit("RGB").alias("color_mode"),
        F.lit(1).alias("frame_count"),
        F.lit(False).alias("has_metadata"),
    ).cast(schemas.IMAGE)
    return files.select(
        "doc_id",
        "source",
        "analysis_id",
        "original_name",
        "declared_content_type",
        "size_bytes",
        F.when(F.col("doc_id") % 37 != 0, F.sha2("text", 256)).alias("sha256"),
        "header_kind",
        "document_type",
        F.when(F.col("detected_no") == 9, F.array(F.lit("71742020"))).alias("brands"),
        "probe_status",
        P.flatten(F.col("probe_json")).alias("probe"),
        "read_status",
        F.when(F.col("detected_no") < 4, image).alias("image"),
        *more,
    )


@query(
    "gate_first_error",
    f"{GATE_SQL} SELECT doc_id, status, CASE WHEN status = 'rejected' THEN {_CHECK_NAME} END AS failed_check, error_code FROM o",
)
def gate_first_error(spark: SparkSession, sf: str) -> DataFrame:
    return gate.run_gate(gate_inputs(view(spark, sf, "files_v")), PARAMS).select(
        "doc_id", "status", "failed_check", "error_code"
    )


_PASSED = (
    "CASE WHEN failed_at = 99 OR status = 'failed' THEN NULL ELSE CAST(CASE failed_at WHEN 0 THEN 12 ELSE failed_at - 1 END "
    "- CASE WHEN declared_content_type IS NULL AND (failed_at = 0 OR failed_at > 8) THEN 1 ELSE 0 END AS INT) END"
)


@query(
    "gate_checks_passed",
    f"{GATE_SQL} SELECT doc_id, {_PASSED} AS n_passed, CASE WHEN failed_at = 99 OR status = 'failed' THEN NULL ELSE {_CHECK_NAME} END AS last_failed, "
    "CASE error_code WHEN 'file_empty' THEN 'validation' WHEN 'missing_extension' THEN 'unsupported_media' "
    "WHEN 'unsupported_extension' THEN 'unsupported_media' WHEN 'unsupported_mime_type' THEN 'unsupported_media' "
    "WHEN 'unsafe_or_unreadable_file' THEN 'validation' WHEN 'file_signature_mismatch' THEN 'validation' "
    "WHEN 'file_too_large' THEN 'resource_limit' WHEN 'internal_error' THEN 'internal' END AS category, "
    f"CAST(CASE WHEN failed_at = 99 THEN {PARAMS.hard_limit_bytes} WHEN failed_at = 9 AND status = 'rejected' THEN {_LIMIT} END AS BIGINT) AS max_size_bytes, "
    "CASE WHEN failed_at IN (7, 8) AND status = 'rejected' THEN detected_mime END AS detail_mime FROM o",
)
def gate_checks_passed(spark: SparkSession, sf: str) -> DataFrame:
    out = gate.validate(gate_inputs(view(spark, sf, "files_v")), PARAMS)
    checks, error = F.col("validation.checks"), F.get(F.col("errors"), F.lit(0))
    detail = error["safe_details"]
    return out.select(
        "doc_id",
        F.when(F.col("validation").isNotNull(), F.size(F.filter(checks, lambda c: c["passed"]))).alias("n_passed"),
        F.get(F.filter(checks, lambda c: ~c["passed"]), F.lit(0))["code"].alias("last_failed"),
        error["category"].alias("category"),
        F.try_variant_get(detail, "$.max_size_bytes", "bigint").alias("max_size_bytes"),
        F.try_variant_get(detail, "$.detected_mime_type", "string").alias("detail_mime"),
    )


@query(
    "gate_outcomes",
    f"{GATE_SQL} SELECT source AS source_name, status, error_code, count(*) AS n_files FROM o GROUP BY ALL",
)
def gate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = gate.run_gate(gate_inputs(view(spark, sf, "files_v")), PARAMS).withColumnRenamed("source", "source_name")
    return rejections_by_source(verdicts)


@query(
    "hard_limit",
    f"{cte(*FILES)} SELECT doc_id, size_bytes FROM files_v WHERE size_bytes > {PARAMS.hard_limit_bytes}",
)
def hard_limit(spark: SparkSession, sf: str) -> DataFrame:
    return (
        view(spark, sf, "files_v")
        .where(F.col("size_bytes") > PARAMS.hard_limit_bytes)
        .select("doc_id", "size_bytes")
    )


@query(
    "outcome_union",
    f"{GATE_SQL} SELECT doc_id, status, CASE WHEN status <> 'accepted' THEN 'finished' END AS stage, "
    "CASE WHEN status <> 'accepted' THEN 'not_assessed' END AS completeness_status, "
    "CASE WHEN status = 'accepted' THEN detected_mime END AS mime FROM o",
)
def outcome_union(spark: SparkSession, sf: str) -> DataFrame:
    out = gate.validate(gate_inputs(view(spark, sf, "files_v")), PARAMS)
    return gate.with_terminal_fields(out).select(
        "doc_id",
        "status",
        "stage",
        "completeness_status",
        F.col("validated_file.detected_mime_type").alias("mime"),
    )


@query(
    "outcome_rules",
    f"{GATE_SQL} SELECT status, count(*) AS n_rows, count(*) FILTER (CASE doc_id % 5 WHEN 1 THEN status = 'accepted' "
    "WHEN 2 THEN status <> 'accepted' WHEN 3 THEN true ELSE false END) AS n_inconsistent FROM o GROUP BY status",
)
def outcome_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes as stored, a known share of them damaged: another size in the descriptor, no errors, the wrong status."""
    c = F.col
    out = gate.validate(gate_inputs(view(spark, sf, "files_v")), PARAMS)
    kind, accepted = c("doc_id") % 5, c("status") == "accepted"
    out = out.select(
        "status",
        "validation",
        F.when(kind == 3, F.when(accepted, "rejected").when(c("status") == "rejected", "accepted").otherwise("completed"))
        .otherwise(c("status"))
        .alias("stored_status"),
        F.when((kind == 1) & accepted, c("validated_file").withField("size_bytes", c("validated_file.size_bytes") + 1))
        .otherwise(c("validated_file"))
        .alias("validated_file"),
        F.when(kind == 2, F.slice("errors", 1, 0)).otherwise(c("errors")).alias("errors"),
    )
    n_errors = F.size("errors")
    ok = F.when(
        F.col("stored_status") == "accepted",
        gate.accepted_is_consistent(F.col("validation"), F.col("validated_file"))
        & R.validation_rules(lambda n: F.col("validation")[n])["R07"]
        & R.file_rules(lambda n: F.col("validated_file")[n])["R06"],
    ).otherwise(
        gate.terminal_is_consistent(
            F.col("stored_status"), n_errors, F.col("validation"), F.col("validated_file")
        )
    )
    return out.groupBy("status").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_inconsistent")
    )


@query(
    "declared_as_of",
    f"""{cte('received_v', 'declaration_v')}, d AS (
      SELECT r.path, d.original_name, d.declared_content_type,
        row_number() OVER (PARTITION BY r.path ORDER BY d.declared_at DESC, d.version DESC, d.original_name DESC, d.declared_content_type DESC NULLS LAST) AS n
      FROM received_v r JOIN declaration_v d ON d.path = r.path AND d.declared_at <= r.arrived)
    SELECT r.path, strlen(r.body)::BIGINT AS size_bytes, sha256(r.body) AS sha256, coalesce(d.original_name, split_part(r.path, '/', 2)) AS original_name,
      {_MIME} AS declared_mime, true AS registered
    FROM received_v r LEFT JOIN d ON d.path = r.path AND d.n = 1""",
)
def declared_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bytes measured, registered with a safe id and a UTC time, and named as of their arrival."""
    body = F.col("body").cast("binary")
    files = view(spark, sf, "received_v").select(
        "path", F.col("arrived").alias("modificationTime"), F.length(body).cast("long").alias("length"), body.alias("content")
    )
    as_of = F.lit("2031-02-03T06:00:00Z")
    known = media.measure(media.register(files, F.lit("api"), as_of).drop("original_name", "declared_content_type"), PARAMS)
    named = media.declared_as_of(known, view(spark, sf, "declaration_v"))
    return named.select(
        "path",
        "size_bytes",
        "sha256",
        "original_name",
        X.normalized_mime(F.col("declared_content_type")).alias("declared_mime"),
        media.registration_valid(F.col("analysis_id"), F.col("registered_at"), F.col("size_bytes")).alias("registered"),
    )
