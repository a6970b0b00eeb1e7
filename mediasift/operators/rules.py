"""Integrity rules of the data model as named predicates.

Every rule is a boolean column that must be true. `with_violations` collects the names of the
rules a row breaks; nothing is dropped, and callers split valid from rejected rows themselves.

Rule functions take an accessor, so the same rule serves a table column (`F.col`) and an
element of a nested array (`lambda name: element[name]`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.functions import jsontypes as J
from mediasift.functions import text as X
from mediasift.functions.base import let, text_array, text_map
from mediasift.params import Params

Get = Callable[[str], Column]


def both(*rules: Column) -> Column:
    return reduce(lambda a, b: a & b, rules)


def implies(condition: Column, consequence: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(consequence, F.lit(False))


def _filled(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def _empty(array: Column) -> Column:
    return ~_filled(array)


def _at_least_zero(*values: Column) -> Column:
    return both(*[F.coalesce(v >= 0, F.lit(True)) for v in values])


def _unit(*values: Column) -> Column:
    return both(*[F.coalesce(v.between(0.0, 1.0), F.lit(False)) for v in values])


# --- accessor-based rule sets ----------------------------------------------------------
def file_rules(g: Get) -> dict[str, Column]:
    """Technical parameters belong to the media type."""
    p = g("technical_parameters")
    has = {m: p[m].isNotNull() for m in vocab.MEDIA_TYPES}
    match = F.lit(False)
    for m in vocab.MEDIA_TYPES:
        others = [~has[o] for o in vocab.MEDIA_TYPES if o != m]
        match = match | ((g("media_type") == m) & both(has[m], *others))
    return {"R05": g("media_type").isin(*vocab.MEDIA_TYPES), "R06": match}


def validation_rules(g: Get) -> dict[str, Column]:
    return {
        "R07": F.when(
            g("accepted"), g("validated_file").isNotNull() & _empty(g("errors"))
        ).otherwise(g("validated_file").isNull() & _filled(g("errors")))
    }


def analyzer_rules(g: Get) -> dict[str, Column]:
    status = g("status")
    return {
        "R01": X.is_finite(g("score")),
        "R05": status.isin(*vocab.ANALYZER_STATUSES) & g("media_type").isin(*vocab.MEDIA_TYPES),
        "R08": g("score").isNull() | g("score_name").isNotNull(),
        "R09": implies(status == "not_applicable", ~g("applicable")),
        "R10": implies(status.isin("error", "timeout"), _filled(g("errors"))),
        "R11": implies(
            status == "skipped", ~X.is_blank(g("summary")) | X.any_not_blank(g("warnings"))
        ),
        "R12": _at_least_zero(g("duration_ms")),
    }


def localization_rules(g: Get) -> dict[str, Column]:
    """Range and order rules of the four localization kinds."""
    kind = g("type")
    own = {
        "file": (),
        "bounding_box": ("x", "y", "width", "height", "coordinate_space"),
        "time_interval": ("start_seconds", "end_seconds"),
        "frame_interval": ("start_frame", "end_frame"),
    }
    fields = [f for names in own.values() for f in names]
    closed = F.lit(False)
    for name, mine in own.items():
        absent = [g(f).isNull() for f in fields if f not in mine]
        present = [g(f).isNotNull() for f in mine]
        closed = closed | ((kind == name) & both(F.lit(True), *absent, *present))
    return {
        "R13": implies(
            kind == "bounding_box",
            both(
                _unit(g("x"), g("y"), g("width"), g("height")),
                g("coordinate_space") == vocab.COORDINATE_SPACE,
            ),
        ),
        "R14": implies(
            kind == "time_interval",
            (g("start_seconds") >= 0) & (g("start_seconds") <= g("end_seconds")),
        ),
        "R15": implies(
            kind == "frame_interval", (g("start_frame") >= 0) & (g("start_frame") <= g("end_frame"))
        ),
        "R16": closed,
    }


def finding_rules(g: Get) -> dict[str, Column]:
    place = g("localization")
    nested = both(
        *[F.coalesce(rule, F.lit(False)) for rule in localization_rules(lambda n: place[n]).values()]
    )
    return {
        "R01": X.is_finite(g("source_score")) & X.is_finite(g("score_impact")),
        "R05": g("severity").isin(*vocab.SEVERITIES),
        "R13-16": place.isNull() | nested,
    }


def completeness_rules(g: Get) -> dict[str, Column]:
    counters = [
        g(f"{n}_analyzers")
        for n in ("planned", "applicable", "completed", "failed", "timed_out", "skipped", "not_applicable")
    ]
    return {
        "R05": g("status").isin(*vocab.COMPLETENESS_STATUSES),
        "R17": both(*[F.coalesce(c >= 0, F.lit(False)) for c in counters], _unit(g("coverage_ratio"))),
    }


def risk_rules(g: Get) -> dict[str, Column]:
    levels = vocab.RISK_LEVELS
    return {
        "R01": X.is_finite(g("score")) & X.is_finite(g("probability")),
        "R05": F.coalesce(g("final_level").isin(*levels), F.lit(True))
        & F.coalesce(g("score_based_level").isin(*levels), F.lit(True)),
        "R18": implies(
            g("probability").isNotNull(),
            g("probability_method").isNotNull() & ~X.is_blank(g("probability_method")),
        ),
        "R19": implies(g("critical_override_applied"), _filled(g("critical_finding_ids"))),
    }


def terminal_rules(
    *,
    status: Column,
    validated: Column,
    completeness: Column,
    level: Column,
    n_analyzers: Column,
    n_findings: Column,
    n_errors: Column,
    limitation_explained: Column,
) -> dict[str, Column]:
    """What each terminal status demands of the whole result."""
    return {
        "R20": implies(
            status == "completed", validated & (completeness == "complete") & level.isNotNull()
        ),
        "R21": implies(
            status == "partial", validated & (completeness == "partial") & level.isNotNull()
        ),
        "R22": implies(status == "partial", limitation_explained),
        "R23": implies(
            status == "rejected",
            (n_analyzers == 0)
            & (n_findings == 0)
            & level.isNull()
            & (completeness == "not_assessed")
            & (n_errors > 0),
        ),
        "R24": implies(status == "failed", level.isNull() & (n_errors > 0)),
        "R25": implies(completeness == "insufficient", level.isNull()),
    }


def context_rules(g: Get, *times: str) -> dict[str, Column]:
    """A context has ids, and those of its times that are set are UTC texts."""
    return {
        "R29": both(
            F.coalesce(g("analysis_id"), F.lit("")) != "",
            F.coalesce(g("config_snapshot_id"), F.lit("")) != "",
            *[g(t).isNull() | X.is_utc_text(g(t)) for t in times],
        )
    }


def log_rules(g: Get) -> dict[str, Column]:
    return {"R34": g("event").isin(*vocab.LOG_EVENTS)}


# --- collecting violations -------------------------------------------------------------
def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that are not true, in the order given."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))
                for name, rule in rules.items()
            ]
        )
    )


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") > 0)


def violation_counts(df: DataFrame) -> DataFrame:
    return (
        df.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n_rows"))
    )


# --- shape of stored documents -----------------------------------------------------------
# Type letters: S text, I integer, N number, B boolean, O object, A array; `0` allows null.
# A `?` after a name means the key may be left out.
SHAPES: dict[str, dict[str, str]] = {
    "result": {
        "schema_version?": "S", "analysis_id": "S", "created_at": "S", "updated_at": "S",
        "status": "S", "stage": "S", "source": "O", "file": "O", "processing": "O",
        "analyzers": "A", "findings": "A", "completeness": "O", "risk_assessment": "O",
        "recommendation": "O", "cleanup": "O", "warnings": "A", "errors": "A",
    },
    "source": {"channel": "S", "connector?": "S0", "external_system?": "S0", "external_reference?": "S0"},
    "input_file": {
        "original_name": "S", "declared_content_type": "S0", "size_bytes": "I", "received_at": "S",
    },
    "validated_file": {
        "original_name": "S", "extension": "S", "declared_mime_type": "S0", "detected_mime_type": "S",
        "media_type": "S", "size_bytes": "I", "sha256": "S", "signature_match": "B",
        "safe_read": "B", "technical_parameters": "O",
    },
    "image": {
        "width": "I", "height": "I", "format": "S", "color_mode": "S", "frame_count?": "I0",
        "has_metadata": "B",
    },
    "audio": {
        "duration_seconds": "N", "sample_rate_hz": "I", "channels": "I", "codec": "S",
        "bitrate_bps?": "I0",
    },
    "video": {
        "duration_seconds": "N", "container": "S", "video_codec": "S", "audio_codec?": "S0",
        "width": "I", "height": "I", "fps": "N", "bitrate_bps?": "I0", "has_audio": "B",
    },
    "processing": {
        "queued_at": "S", "started_at": "S0", "finished_at": "S0", "duration_ms": "I0",
        "config_snapshot_id": "S", "application_version": "S",
    },
    "analyzer": {
        "analyzer_id": "S", "analyzer_version": "S", "media_type": "S", "group": "S", "status": "S",
        "applicable": "B", "started_at": "S0", "finished_at": "S0", "duration_ms": "I0",
        "score": "N0", "score_name": "S0", "summary": "S", "raw_metrics": "O",
        "candidate_findings": "A", "warnings": "A", "errors": "A",
    },
    "finding": {
        "finding_id": "S", "group": "S", "type": "S", "severity": "S", "source_analyzer_id": "S",
        "source_analyzer_version": "S", "description": "S", "localization": "O0",
        "source_score": "N0", "score_impact": "N0", "critical_override_eligible": "B",
        "correlation_group": "S0", "evidence_refs": "A",
    },
    "file": {"type": "S"},
    "bounding_box": {
        "type": "S", "x": "N", "y": "N", "width": "N", "height": "N", "coordinate_space": "S",
    },
    "time_interval": {"type": "S", "start_seconds": "N", "end_seconds": "N"},
    "frame_interval": {"type": "S", "start_frame": "I", "end_frame": "I"},
    "completeness": {
        "status": "S", "planned_analyzers": "I", "applicable_analyzers": "I",
        "completed_analyzers": "I", "failed_analyzers": "I", "timed_out_analyzers": "I",
        "skipped_analyzers": "I", "not_applicable_analyzers": "I", "coverage_ratio": "N",
        "missing_capabilities": "A", "explanation": "S",
    },
    "risk_assessment": {
        "model_id": "S", "model_version": "S", "score": "N0", "score_based_level": "S0",
        "critical_override_applied": "B", "critical_finding_ids": "A", "final_level": "S0",
        "probability": "N0", "probability_method": "S0", "summary": "S", "explanation": "S",
        "limitations": "A",
    },
    "recommendation": {
        "primary_action": "S", "additional_actions": "A", "text": "S", "requires_manual_review": "B",
    },
    "cleanup": {
        "status": "S", "original_file_deleted": "B", "intermediate_files_deleted": "B",
        "quarantine_used": "B", "finished_at": "S0", "errors": "A",
    },
    "error": {
        "code": "S", "category": "S", "message": "S", "retryable": "B", "field?": "S0",
        "analyzer_id?": "S0", "safe_details?": "O",
    },
}
_SCALARS = {
    "S": (J.STRING,),
    "I": (J.BIGINT,),
    "N": (J.BIGINT, J.DECIMAL, J.DOUBLE, J.FLOAT),
    "B": (J.BOOLEAN,),
    "0": (J.VOID,),
}
Body = Callable[[Column], Column]


def _no_names() -> Column:
    return F.expr("cast(array() AS array<string>)")


def shape_violations(
    value: Column, shape: str, *, strict: bool = True, children: Body | None = None
) -> Column:
    """Unknown keys (R03), missing keys (R04) and wrong JSON types of one object.

    The object is opened once, as a map of its members; `children` may look further into them.
    Types of scalars are compared by name; objects and arrays are recognised by opening them, which
    does not describe their whole content.
    """
    spec = {name.rstrip("?"): (name.endswith("?"), code) for name, code in SHAPES[shape].items()}
    allowed = text_array(spec)
    required = text_array(k for k, (optional, _) in spec.items() if not optional)
    scalars = {k: code for k, (_, code) in spec.items() if code[0] not in "OA"}
    kinds = text_map(
        {k: " ".join(kind for letter in code for kind in _SCALARS[letter]) for k, code in scalars.items()}
    )
    nested = {k: code for k, (_, code) in spec.items() if code[0] in "OA"}

    def judge(members: Column) -> Column:
        keys = F.map_keys(members)
        # members come sorted by key, so a complete object is recognised by one comparison
        odd_keys = F.concat(
            F.transform(
                F.array_except(required, keys), lambda k: F.concat(F.lit(f"R04:{shape}."), k)
            ),
            F.transform(
                F.array_except(keys, allowed), lambda k: F.concat(F.lit(f"R03:{shape}."), k)
            )
            if strict
            else _no_names(),
        )
        parts = [
            F.when(keys == text_array(sorted(spec)), _no_names()).otherwise(odd_keys),
            F.transform(
                F.filter(
                    F.map_entries(members),
                    # a null variant is JSON null; keys that are no scalars find no kinds
                    lambda e: ~F.coalesce(
                        F.contains(
                            F.try_element_at(kinds, e["key"]),
                            F.coalesce(J.kind(e["value"]), F.lit(J.VOID)),
                        ),
                        F.lit(True),
                    ),
                ),
                lambda e: F.concat(F.lit(f"TYPE:{shape}."), e["key"]),
            ),
        ]
        nested_wrong = []
        for key, code in nested.items():
            member = F.try_element_at(members, F.lit(key))
            opened = J.members(member) if code[0] == "O" else J.items(member)
            wrong = member.isNotNull() & opened.isNull()
            if code.endswith("0"):
                wrong = wrong & ~F.is_variant_null(member)
            nested_wrong.append(F.when(wrong, F.lit(f"TYPE:{shape}.{key}")))
        if nested_wrong:
            parts.append(F.array_compact(F.array(*nested_wrong)))
        if children is not None:
            parts.append(children(members))
        return F.concat(*parts)

    return F.coalesce(let(J.members(value), judge), _no_names())


_SCALAR_TYPES = {"S": "STRING", "I": "BIGINT", "N": r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)", "B": "BOOLEAN"}
#: Content of nested values that is not looked into: whatever has no nested value and no quoted name.
_FLAT = "[^<>`]*"
_TEXTS_TYPE = "ARRAY<(?:VOID|STRING)>"
_TEXTS_JSON = r'\[(?:"[^"\\]*"(?:,"[^"\\]*")*)?\]'
_ERROR_JSON = r'\{"category":"[^"\\]*","code":"[^"\\]*","message":"[^"\\]*","retryable":(?:true|false)\}'


def _type_pattern(shape: str, **nested: str) -> str:
    """How `schema_of_variant` writes an object of the shape without violations; `nested` has its arrays and objects."""
    fields = []
    for name, code in sorted((name.rstrip("?"), code) for name, code in SHAPES[shape].items()):
        kind = nested.get(name) or {"O": f"OBJECT<{_FLAT}>", "A": f"ARRAY<{_FLAT}>"}.get(code[0]) or _SCALAR_TYPES[code[0]]
        field = f"{name}: " + (f"(?:{kind}|VOID)" if code.endswith("0") else kind) + "(?:, |(?=>))"
        fields.append(f"(?:{field})?" if f"{name}?" in SHAPES[shape] else field)
    return f"OBJECT<{''.join(fields)}>"


def is_plain_document(doc: Column, described: Column) -> Column:
    """True only for documents without shape violations, told from `described`, their `schema_of_variant`.

    The type of an array is that of all its items together: it shows what no item may have, but neither a
    key that one item lacks nor a null, for which items are opened once. What is not so plain (errors with
    optional keys, places other than the file, nested metrics) is left to `document_shape`.
    """
    errors_type = f"ARRAY<(?:VOID|{_type_pattern('error')})>"
    parameters = "|".join(_type_pattern(kind) for kind in vocab.MEDIA_TYPES)
    pattern = _type_pattern(
        "result",
        source=_type_pattern("source"),
        file=_type_pattern("validated_file", technical_parameters=f"(?:{parameters})"),
        processing=_type_pattern("processing"),
        analyzers=f"ARRAY<(?:VOID|{_type_pattern('analyzer', warnings=_TEXTS_TYPE, errors=errors_type)})>",
        findings=f"ARRAY<(?:VOID|{_type_pattern('finding', evidence_refs=_TEXTS_TYPE, localization=_type_pattern('file'))})>",
        completeness=_type_pattern("completeness", missing_capabilities=_TEXTS_TYPE),
        risk_assessment=_type_pattern("risk_assessment", critical_finding_ids=_TEXTS_TYPE, limitations=_TEXTS_TYPE),
        recommendation=_type_pattern("recommendation", additional_actions=_TEXTS_TYPE),
        cleanup=_type_pattern("cleanup", errors=errors_type),
        warnings=_TEXTS_TYPE,
        errors=errors_type,
    )

    def items(path: str, good: Body, kind: str = "string") -> Column:
        return F.forall(F.try_variant_get(doc, f"$.{path}", f"array<{kind}>"), lambda e: F.coalesce(good(e), F.lit(False)))

    def records(path: str, shape: str, *rules: Body) -> Column:
        nullable = [name for name, code in SHAPES[shape].items() if code.endswith("0")]

        def good(members: Column) -> Column:
            missing = F.map_filter(members, lambda k, v: v.isNull() & ~k.isin(*nullable))
            return both(F.size(members) == len(SHAPES[shape]), F.size(missing) == 0, *[rule(members) for rule in rules])

        return items(path, good, "map<string,string>")

    def written(key: str, json: str) -> Body:
        return lambda members: F.try_element_at(members, F.lit(key)).rlike(rf"^{json}\z")

    texts = "warnings completeness.missing_capabilities risk_assessment.critical_finding_ids risk_assessment.limitations recommendation.additional_actions"
    return F.coalesce(
        both(
            described.rlike(rf"^{pattern}\z"),
            *[items(path, lambda e: e.isNotNull()) for path in texts.split()],
            *[items(path, lambda e: e.rlike(rf"^{_ERROR_JSON}\z")) for path in ("errors", "cleanup.errors")],
            records("analyzers", "analyzer", written("warnings", _TEXTS_JSON), written("errors", rf"\[(?:{_ERROR_JSON}(?:,{_ERROR_JSON})*)?\]")),
            records(
                "findings",
                "finding",
                written("evidence_refs", _TEXTS_JSON),
                lambda m: F.coalesce(F.try_element_at(m, F.lit("localization")), F.lit('{"type":"file"}')) == '{"type":"file"}',
            ),
        ),
        F.lit(False),
    )


#: ASCII that needs no escape in a JSON text, each character by itself: Java tests ranges more slowly.
_JSON_BARE = "[" + "".join(f"\\{c}" if c in "[]^-&" else c for c in map(chr, range(32, 127)) if c not in '"\\') + "]*"
#: U+FFFD is left out because bytes that are no UTF-8 are read as it.
_JSON_OTHER = r'(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})|[^\x00-\x7E\uFFFD])'
_JSON_STRING = f'"{_JSON_BARE}(?:{_JSON_OTHER}{_JSON_BARE})*+"'
_JSON_INTEGER = r"-?+(?:0|[1-9]\d{0,17}+)"
_JSON_NUMBER = rf"{_JSON_INTEGER}(?:\.\d{{1,17}}+)?+(?:[eE][-+]?+\d{{1,2}}+)?+"
_JSON_SCALARS = {"S": _JSON_STRING, "I": _JSON_INTEGER, "N": _JSON_NUMBER, "B": "(?:true|false)"}


def _json_list(item: str) -> str:
    return rf"\[(?>{item}(?:,{item})*+)?+\]"


def _json_pattern(shape: str, unknown: str = "", **nested: str) -> str:
    """JSON text of an object of the shape without violations, without spaces and with its fields in the order of
    `SHAPES`; `nested` has the patterns of its lists and objects, others are lists of texts and empty objects.
    Members that `unknown` matches may stand anywhere between."""
    before, after = (f"(?:{unknown},)*+", f"(?:,{unknown})*+") if unknown else ("", "")
    text, follows = before, False
    for name, code in SHAPES[shape].items():
        value = nested.get(name) or {"O": r"\{\}", "A": _json_list(_JSON_STRING)}.get(code[0]) or _JSON_SCALARS[code[0]]
        member = f'"{name.rstrip("?")}":' + (f"(?:{value}|null)" if code.endswith("0") else value)
        if name.endswith("?"):
            text += f"(?:,{member})?+{after}" if follows else f"(?:{member},)?+{before}"
        else:
            text, follows = text + ("," if follows else "") + member + after, True
    return rf"\{{{text}\}}"


def _document_pattern(unknown: str = "") -> str:
    errors = _json_list(_json_pattern("error"))
    parameters = "|".join(_json_pattern(kind) for kind in vocab.MEDIA_TYPES)
    files = (_json_pattern("validated_file", technical_parameters=f"(?:{parameters})"), _json_pattern("input_file"))
    places = "|".join(_json_pattern(kind, type=f'"{kind}"') for kind in vocab.LOCALIZATION_TYPES)
    return _json_pattern(
        "result",
        unknown,
        source=_json_pattern("source"),
        file=f"(?:{'|'.join(files)})",
        processing=_json_pattern("processing"),
        analyzers=_json_list(_json_pattern("analyzer", errors=errors)),
        findings=_json_list(_json_pattern("finding", localization=f"(?:{places})")),
        completeness=_json_pattern("completeness"),
        risk_assessment=_json_pattern("risk_assessment"),
        recommendation=_json_pattern("recommendation"),
        cleanup=_json_pattern("cleanup", errors=errors),
        errors=errors,
    )


def is_plain_text(doc: Column) -> Column:
    """True only for texts that are UTF-8 and JSON within the number range, without shape violations.

    One pass over the text decides, nothing is parsed: its pattern follows from `SHAPES` and never backtracks into
    a field. Other orders of fields, spaces, metrics and unknown fields are left to `document_shape`."""
    return doc.rlike(rf"^{_document_pattern()}\z")


def is_plain_beside_unknown(doc: Column) -> Column:
    """The same, with unknown scalar fields of the document anywhere between its own; they may repeat."""
    known = "|".join(name.rstrip("?") for name in SHAPES["result"])
    scalar = f"(?:{_JSON_STRING}|{_JSON_NUMBER}|true|false|null)"
    unknown = rf'"(?!(?:{known})")[ !#-\[\]-~]*+":{scalar}'
    return doc.rlike(rf"^{_document_pattern(unknown)}\z")


def unknown_fields(doc: Column, *, strict: bool = True) -> Column:
    """R03 for each unknown field of a document that is plain beside them; null if one repeats, as it is no JSON then."""
    known = text_array(name.rstrip("?") for name in SHAPES["result"])

    def listed(names: Column) -> Column:
        unknown = F.transform(F.array_sort(F.array_except(names, known)), lambda k: F.concat(F.lit("R03:result."), k))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), unknown if strict else _no_names())

    return let(F.json_object_keys(doc), listed)


def document_shape(doc: Column, *, strict: bool = True) -> Column:
    """Shape violations of a stored result, at every nesting level."""

    def shape(value: Column, name: str, children: Body | None = None) -> Column:
        return shape_violations(value, name, strict=strict, children=children)

    def at(members: Column, key: str) -> Column:
        return F.try_element_at(members, F.lit(key))

    def each(members: Column, key: str, body: Body) -> Column:
        found = F.flatten(F.transform(J.items(at(members, key)), body))
        return F.coalesce(found, _no_names())

    def texts(members: Column, *keys: str) -> Column:
        """Arrays that hold texts only."""
        return F.concat(
            *[
                F.when(
                    F.exists(J.items(at(members, key)), lambda e: J.kind(e) != J.STRING),
                    text_array([f"TYPE:{key}"]),
                ).otherwise(_no_names())
                for key in keys
            ]
        )

    def errors(members: Column) -> Column:
        return each(members, "errors", lambda e: shape(e, "error"))

    def technical(members: Column) -> Column:
        p = at(members, "technical_parameters")
        return (
            F.when(~J.is_missing(p, "color_mode"), shape(p, "image"))
            .when(~J.is_missing(p, "video_codec"), shape(p, "video"))
            .otherwise(shape(p, "audio"))
        )

    def media_file(value: Column) -> Column:
        return F.when(J.is_missing(value, "sha256"), shape(value, "input_file")).otherwise(
            shape(value, "validated_file", technical)
        )

    def place(members: Column) -> Column:
        value = at(members, "localization")
        kind = J.scalar_text(J.member(value, "type"))
        out = F.when(value.isNull() | F.is_variant_null(value), _no_names())
        for name in vocab.LOCALIZATION_TYPES:
            out = out.when(kind == name, shape(value, name))
        return out.otherwise(text_array(["R16:localization"]))

    def analyzer(value: Column) -> Column:
        return shape(value, "analyzer", lambda m: F.concat(texts(m, "warnings"), errors(m)))

    def finding(value: Column) -> Column:
        return shape(value, "finding", lambda m: F.concat(texts(m, "evidence_refs"), place(m)))

    def whole(m: Column) -> Column:
        return F.concat(
            shape(at(m, "source"), "source"),
            media_file(at(m, "file")),
            shape(at(m, "processing"), "processing"),
            each(m, "analyzers", analyzer),
            each(m, "findings", finding),
            shape(
                at(m, "completeness"), "completeness", lambda c: texts(c, "missing_capabilities")
            ),
            shape(
                at(m, "risk_assessment"),
                "risk_assessment",
                lambda r: texts(r, "critical_finding_ids", "limitations"),
            ),
            shape(
                at(m, "recommendation"), "recommendation", lambda r: texts(r, "additional_actions")
            ),
            shape(at(m, "cleanup"), "cleanup", errors),
            texts(m, "warnings"),
            errors(m),
        )

    return shape(doc, "result", whole)


def finite_numbers(r: Column) -> Column:
    """Every number of a typed stored result is finite."""
    p, risk = r["file"]["technical_parameters"], r["risk_assessment"]
    single = (
        p["duration_seconds"],
        p["fps"],
        r["completeness"]["coverage_ratio"],
        risk["score"],
        risk["probability"],
    )
    place = ("x", "y", "width", "height", "start_seconds", "end_seconds")
    return both(
        *[X.is_finite(v) for v in single],
        F.forall(r["analyzers"], lambda a: X.is_finite(a["score"])),
        F.forall(
            r["findings"],
            lambda f: both(
                X.is_finite(f["source_score"]),
                X.is_finite(f["score_impact"]),
                *[X.is_finite(f["localization"][n]) for n in place],
            ),
        ),
    )


def result_rules(r: Column) -> dict[str, Column]:
    """Rules over a typed stored result."""

    def all_of(array: Column, rules: Callable[[Get], dict[str, Column]]) -> Column:
        return F.forall(
            array,
            lambda e: both(
                *[F.coalesce(x, F.lit(False)) for x in rules(lambda n: e[n]).values()]
            ),
        )

    def utc(*values: Column) -> Column:
        return both(*[v.isNull() | X.is_utc_text(v) for v in values])

    def error_ok(array: Column) -> Column:
        return F.forall(array, lambda e: e["category"].isin(*vocab.ERROR_CATEGORIES))

    file, risk, done = r["file"], r["risk_assessment"], r["completeness"]
    p = file["technical_parameters"]
    validated = file["sha256"].isNotNull()
    is_kind = {
        "image": p["color_mode"].isNotNull(),
        "audio": p["sample_rate_hz"].isNotNull(),
        "video": p["video_codec"].isNotNull(),
    }
    parameters_match = F.lit(False)
    for name, present in is_kind.items():
        parameters_match = parameters_match | ((file["media_type"] == name) & present)
    actions = vocab.RECOMMENDED_ACTIONS
    return {
        "R01": finite_numbers(r),
        "R02": utc(
            r["created_at"], r["updated_at"], file["received_at"], r["processing"]["queued_at"],
            r["processing"]["started_at"], r["processing"]["finished_at"], r["cleanup"]["finished_at"],
        )
        & F.forall(r["analyzers"], lambda a: utc(a["started_at"], a["finished_at"])),
        "R05": both(
            r["status"].isin(*vocab.ANALYSIS_STATUSES),
            r["stage"].isin(*vocab.STAGES),
            r["source"]["channel"].isin(*vocab.SOURCE_CHANNELS),
            r["cleanup"]["status"].isin(*vocab.CLEANUP_STATUSES),
            r["recommendation"]["primary_action"].isin(*actions),
            F.forall(r["recommendation"]["additional_actions"], lambda a: a.isin(*actions)),
            error_ok(r["errors"]),
            error_ok(r["cleanup"]["errors"]),
            F.forall(r["analyzers"], lambda a: error_ok(a["errors"])),
        ),
        "R06": ~validated | parameters_match,
        "R08-12": all_of(r["analyzers"], analyzer_rules),
        "R13-16": all_of(r["findings"], finding_rules),
        "R12": _at_least_zero(r["processing"]["duration_ms"]),
        "R17": both(*completeness_rules(lambda n: done[n]).values()),
        "R18-19": both(*risk_rules(lambda n: risk[n]).values()),
        **terminal_rules(
            status=r["status"],
            validated=validated,
            completeness=done["status"],
            level=risk["final_level"],
            n_analyzers=F.size(r["analyzers"]),
            n_findings=F.size(r["findings"]),
            n_errors=F.size(r["errors"]),
            limitation_explained=X.any_not_blank(r["warnings"])
            | _filled(r["errors"])
            | ~X.is_blank(done["explanation"])
            | X.any_not_blank(risk["limitations"]),
        ),
        "R31": F.coalesce(r["schema_version"], F.lit(vocab.SCHEMA_VERSION)) == vocab.SCHEMA_VERSION,
    }


def check_formats(params: Params) -> None:
    """R32 holds once per run: building `Params` already refuses another format table."""
    Params.__post_init__(params)
