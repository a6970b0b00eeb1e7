"""Stored documents: judging, lenient and strict reads, ordering, round trip, upsert."""

import json

import pytest
from pyspark.sql import functions as F

from mediasift import Params
from mediasift.operators import rules as R
from mediasift.sources import results

from documents import (
    ERROR, NOW, analyzer, finding, input_file, partial, rejected, result, validated_file, without,
)

BOX = {"type": "bounding_box", "x": 0, "y": 0.5, "width": 1, "height": 1.0, "coordinate_space": "normalized"}
SPAN = {"type": "time_interval", "start_seconds": 1, "end_seconds": 1}
FRAMES = {"type": "frame_interval", "start_frame": 0, "end_frame": 9}
AUDIO = {"duration_seconds": 1.5, "sample_rate_hz": 8000, "channels": 1, "codec": "pcm"}
VIDEO = {
    "duration_seconds": 1.5, "container": "mp4", "video_codec": "h264", "width": 1, "height": 1, "fps": 25.0,
    "has_audio": False,
}


def place(p):
    return result(findings=[finding(localization=p)])


GOOD = [
    result(),
    result(schema_version="1.0", analyzers=[analyzer()], findings=[finding()]),
    rejected(),
    rejected(status="failed"),
    partial(),
    partial(warnings=[], errors=[ERROR]),
    partial(warnings=[], completeness__explanation="why"),
    partial(warnings=[], risk_assessment__limitations=[" ", "why"]),
    result(file=validated_file(media_type="audio", technical_parameters=AUDIO)),
    result(file=validated_file(media_type="video", technical_parameters=VIDEO)),
    result(analyzers=[], findings=[]),
    result(analyzers=[analyzer(status="skipped", summary=" ", warnings=["", "off"])]),
    result(analyzers=[analyzer(status="not_applicable", applicable=False, score=None, score_name=None)]),
    result(analyzers=[analyzer(status="timeout", errors=[{**ERROR, "safe_details": {"n": 1}}])]),
    result(risk_assessment__probability=0.5, risk_assessment__probability_method="bayes"),
    result(risk_assessment__critical_override_applied=True, risk_assessment__critical_finding_ids=["f1"]),
    place({"type": "file"}), place(BOX), place(SPAN), place(FRAMES),
    result(created_at="2031-02-03T04:05:06.123456+00:00"),
]

BAD = [
    (result(extra=1), "R03:result.extra"),
    (result(source={"channel": "api", "x": 1}), "R03:source.x"),
    (result(findings=[finding(x=1)]), "R03:finding.x"),
    (place({**SPAN, "x": 1}), "R03:time_interval.x"),
    (without(result(), "warnings"), "R04:result.warnings"),
    (result(findings=[{k: v for k, v in finding().items() if k != "score_impact"}]), "R04:finding.score_impact"),
    (without(result(), "cleanup", "finished_at"), "R04:cleanup.finished_at"),
    (place({k: v for k, v in BOX.items() if k != "x"}), "R04:bounding_box.x"),
    (result(analysis_id=5), "TYPE:result.analysis_id"),
    (result(processing__duration_ms="7"), "TYPE:processing.duration_ms"),
    (result(processing__duration_ms=7.5), "TYPE:processing.duration_ms"),
    (result(warnings="x"), "TYPE:result.warnings"),
    (result(warnings=[1]), "TYPE:warnings"),
    (result(source=None), "TYPE:result.source"),
    (result(findings=[finding(localization=[])]), "TYPE:finding.localization"),
    (result(analyzers=[analyzer(raw_metrics=[])]), "TYPE:analyzer.raw_metrics"),
    (place({"type": "polygon"}), "R16:localization"),
    (result(created_at="2031-02-03T04:05:06+03:00"), "R02"),
    (result(updated_at="2031-02-03T04:05:06"), "R02"),
    (result(analyzers=[analyzer(started_at="2031-02-03T04:05:06+01:00")]), "R02"),
    (result(cleanup__finished_at="yesterday"), "R02"),
    (rejected(file=input_file(received_at="2031-02-03T04:05:06-05:00")), "R02"),
    (result(status="done"), "R05"),
    (result(source__channel="mail"), "R05"),
    (result(recommendation__primary_action="delete"), "R05"),
    (result(errors=[{**ERROR, "category": "other"}]), "R05"),
    (result(file=validated_file(media_type="audio")), "R06"),
    (result(analyzers=[analyzer(score=0.25)]), "R08-12"),
    (result(analyzers=[analyzer(status="not_applicable", applicable=True)]), "R08-12"),
    (result(analyzers=[analyzer(status="error")]), "R08-12"),
    (result(analyzers=[analyzer(status="skipped", summary=" ", warnings=["\t"])]), "R08-12"),
    (result(analyzers=[analyzer(duration_ms=-1)]), "R08-12"),
    (result(processing__duration_ms=-1), "R12"),
    (place({**BOX, "x": 1.001}), "R13-16"),
    (place({**BOX, "height": -0.001}), "R13-16"),
    (place({**BOX, "coordinate_space": "pixels"}), "R13-16"),
    (place({**SPAN, "start_seconds": 2}), "R13-16"),
    (place({**FRAMES, "start_frame": -1}), "R13-16"),
    (result(findings=[finding(severity="mild")]), "R13-16"),
    (result(completeness__coverage_ratio=1.001), "R17"),
    (result(completeness__failed_analyzers=-1), "R17"),
    (result(risk_assessment__probability=0.5), "R18-19"),
    (result(risk_assessment__probability=0.5, risk_assessment__probability_method=" "), "R18-19"),
    (result(risk_assessment__critical_override_applied=True), "R18-19"),
    (result(file=input_file()), "R20"),
    (result(risk_assessment__final_level=None), "R20"),
    (result(completeness__status="partial"), "R20"),
    (partial(completeness__status="complete"), "R21"),
    (partial(warnings=[" "]), "R22"),
    (rejected(analyzers=[analyzer()]), "R23"),
    (rejected(errors=[]), "R23"),
    (rejected(status="failed", risk_assessment__final_level="low"), "R24"),
    (result(completeness__status="insufficient"), "R25"),
    (result(analysis_id="a/b"), "R26"),
    (result(schema_version="2.0"), "R31"),
]


def judged(spark, docs, params=None):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, doc string")
    return [r["violations"] for r in results.judge(df, params).orderBy("i").collect()]


def test_good_documents(spark):
    for doc, found in zip(GOOD, judged(spark, GOOD), strict=True):
        assert found == [], (found, doc)


def test_bad_documents(spark):
    for (doc, rule), found in zip(BAD, judged(spark, [b[0] for b in BAD]), strict=True):
        assert rule in found, (rule, found, doc)


def test_unreadable_documents(spark):
    text = json.dumps(result(risk_assessment__score=8, analyzers=[analyzer(raw_metrics={"bands": [3, {"share": 0.75}]})]))
    docs = [
        "", "{", "[]", "null", text.replace('"score": 8', '"score": NaN'),
        text.replace('"score": 8', '"score": 1e999'), text.replace('"share": 0.75', '"share": -1e999'),
    ]
    assert judged(spark, docs) == [["JSON"]] * 5 + [["R01"]] * 2


def test_unknown_fields_may_be_ignored(spark):
    assert judged(spark, [result(extra=1)], Params(strict_fields=False)) == [[]]


def store(folder, docs):
    folder.mkdir()
    for name, text in docs.items():
        data = text if isinstance(text, bytes) else (text if isinstance(text, str) else json.dumps(text)).encode()
        (folder / name).write_bytes(data)


def ids(n):
    return [f"{i:032x}" for i in range(n)]


def test_directory_reads(spark, tmp_path):
    a, b, c, d = ids(4)
    folder = tmp_path / "store"
    store(
        folder,
        {
            f"{a}.json": result(analysis_id=a),
            f"{b}.json": result(analysis_id=a),
            f"{c}.json": b"\xff\xfe{}",
            f"{d}.json": "{",
            f"{d}.JSON": result(analysis_id=d),
            f"{d}.json.tmp": result(analysis_id=d),
            "NUL.json": result(analysis_id="NUL"),
        },
    )
    (folder / "sub").mkdir()
    store(folder / "sub" / "x", {f"{d}.json": result(analysis_id=d)})
    assert [r["file_name"] for r in results.read_results(spark, str(folder)).collect()] == [f"{a}.json"]
    reasons = {r["file_name"]: r["violations"] for r in results.read_rejected(spark, str(folder)).collect()}
    assert reasons == {
        f"{b}.json": ["R26"], f"{c}.json": ["UTF8"], f"{d}.json": ["JSON"], "NUL.json": ["R26"],
    }
    assert results.get_result(spark, str(folder), a).first()["result"]["analysis_id"] == a
    assert results.get_result(spark, str(folder), "f" * 32).count() == 0
    for bad in (b, d):
        with pytest.raises(Exception, match="corrupted or invalid"):
            results.get_result(spark, str(folder), bad).collect()
    with pytest.raises(ValueError):
        results.get_result(spark, str(folder), "../escape")


def test_recent_order_and_limit(spark, tmp_path):
    a, b, c, d = ids(4)
    late, early = "2031-02-03T05:00:00Z", "2031-02-03T03:00:00.5Z"
    folder = tmp_path / "store"
    store(
        folder,
        {
            f"{c}.json": result(analysis_id=c, created_at=NOW, updated_at=late),
            f"{b}.json": result(analysis_id=b, created_at=NOW),
            f"{a}.json": result(analysis_id=a, created_at=early, updated_at=late),
            f"{d}.json": rejected(analysis_id=d, created_at=late),
            "zz.json": "{",
        },
    )
    summary = results.summaries(results.read_results(spark, str(folder)))
    assert summary.columns == [
        "analysis_id", "created_at", "updated_at", "status", "media_type", "final_risk_level", "completeness_status",
    ]
    rows = results.recent(summary, 3).collect()
    assert [r["analysis_id"] for r in rows] == [d, b, c]
    assert (rows[0]["media_type"], rows[0]["final_risk_level"]) == (None, None)
    assert rows[1]["media_type"] == "image"
    assert [r["analysis_id"] for r in results.recent(summary, 10).collect()] == [d, b, c, a]
    for limit in (0, -1):
        with pytest.raises(ValueError):
            results.recent(summary, limit)


def test_written_documents_read_back_unchanged(spark, tmp_path):
    docs = [
        result(analyzers=[analyzer(raw_metrics={"a": [1, {"b": 0.5}]})]), rejected(),
        place(BOX), place(SPAN), place(FRAMES), place({"type": "file"}),
        result(file=validated_file(media_type="audio", technical_parameters=AUDIO)),
        result(file=validated_file(media_type="video", technical_parameters=VIDEO)),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string").coalesce(1)
    typed = results.judge(df).select("result")
    written = [r["doc"] for r in results.documents(typed, Params(include_raw_metrics=True)).collect()]
    assert judged(spark, written) == [[]] * len(docs)
    for before, after in zip(docs, map(json.loads, written), strict=True):
        for key in ("findings", "completeness", "warnings", "analysis_id", "created_at"):
            assert json.dumps(after[key], sort_keys=True).replace(".0", "") == json.dumps(
                before[key], sort_keys=True
            ).replace(".0", "")
        assert after["file"].keys() == before["file"].keys()
        assert after["source"]["connector"] is None
        assert [a["raw_metrics"] for a in after["analyzers"]] == [a["raw_metrics"] for a in before["analyzers"]]


def test_export_switches(spark):
    doc = result(file__original_name="shore.png", analyzers=[analyzer(raw_metrics={"a": 1})])
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    typed = results.judge(df).select("result")
    plain = json.loads(results.documents(typed).first()["doc"])
    assert plain["analyzers"][0]["raw_metrics"] == {} and plain["file"]["original_name"] == "shore.png"
    hidden = json.loads(results.documents(typed, Params(store_original_name=False)).first()["doc"])
    assert hidden["file"]["original_name"] == ""


def test_non_finite_numbers_fail_the_write(spark):
    df = spark.createDataFrame([(json.dumps(result()),)], "doc string")
    typed = results.judge(df).select("result")
    bad = typed.select(
        F.col("result").withField(
            "risk_assessment", F.col("result.risk_assessment").withField("score", F.lit(float("inf")))
        ).alias("result")
    )
    with pytest.raises(Exception, match="must be finite"):
        results.documents(bad).collect()


def test_upsert_and_existence(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "analysis_id string, ts int, v string")
    new = spark.createDataFrame([("b", 2, "y"), ("b", 3, "z"), ("c", 1, "n")], old.schema)
    after = results.upsert(old, new, "analysis_id", "ts")
    assert sorted(map(tuple, after.collect())) == [("a", 1, "x"), ("b", 3, "z"), ("c", 1, "n")]
    path = results.write_version(after, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        results.write_version(after, str(tmp_path / "t"), 1)
    asked = spark.createDataFrame([("a",), ("q",)], "analysis_id string")
    assert [r[0] for r in results.existing(asked, after).collect()] == ["a"]


def test_violation_counts(spark):
    df = spark.createDataFrame([(["R01", "R02"],), (["R01"],), ([],)], "violations array<string>")
    assert dict(map(tuple, R.violation_counts(df).collect())) == {"R01": 2, "R02": 1}
    assert (R.valid(df).count(), R.rejected(df).count()) == (1, 2)


def test_rule_sets_on_tables(spark):
    rows = [("a", "", None), ("", "c", NOW), ("a", "c", NOW), ("a", "c", None), ("a", "c", NOW[:-1]), ("a", "c", NOW[:-1] + "+01:00")]
    df = spark.createDataFrame(rows, "analysis_id string, config_snapshot_id string, started_at string")
    got = R.with_violations(df, R.context_rules(F.col, "started_at")).select(F.size("violations")).collect()
    assert [r[0] for r in got] == [1, 1, 0, 0, 1, 1]


def test_plain_documents_have_no_shape_violation(spark):
    """Most documents are judged by the text of their type; whatever an array's common type hides goes the long way."""
    two = [analyzer(), analyzer(analyzer_id="b", errors=[ERROR], warnings=["w"])]
    found = [finding(), finding(finding_id="g", localization={"type": "file"})]
    lacking = lambda record, key: {k: v for k, v in record.items() if k != key}
    hidden = [
        result(analyzers=[two[0], lacking(two[1], "summary")]),
        result(analyzers=[two[0], {**two[1], "summary": None}]),
        result(analyzers=[two[0], {**two[1], "errors": [ERROR, lacking(ERROR, "code")]}]),
        result(analyzers=[two[0], {**two[1], "errors": [ERROR, {**ERROR, "code": None}]}]),
        result(analyzers=[two[0], {**two[1], "warnings": [None, "x"]}]),
        result(analyzers=[two[0], None]),
        result(analyzers=[None]),
        result(analyzers=[two[0], {**two[1], "raw_metrics": {}, "raz": {}}]),
        result(analyzers=[{**two[0], "raw_metrics": {"a>, b: OBJECT<": 1}, "raz": {}}]),
        result(findings=[found[0], lacking(found[1], "severity")]),
        result(findings=[found[0], {**found[1], "severity": None}]),
        result(findings=[found[0], {**found[1], "localization": {"type": "polygon"}}]),
        result(findings=[found[0], {**found[1], "localization": {}}]),
        result(findings=[found[0], {**found[1], "evidence_refs": [None]}]),
        result(warnings=[None]),
        result(warnings=["x", None]),
        result(errors=[ERROR, lacking(ERROR, "message")]),
        result(errors=[None]),
        result(risk_assessment__limitations=[None]),
        result(recommendation__additional_actions=["verify_source", None]),
    ]
    plain = [result(analyzers=two, findings=found), result(analyzers=[], findings=[]), result(warnings=["a", "b"], errors=[ERROR, ERROR])]
    docs = [*plain, *hidden, *GOOD, *[doc for doc, _ in BAD]]
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    rows = rows.withColumn("v", F.try_parse_json("doc"))
    told = rows.select("i", R.is_plain_document(F.col("v"), F.schema_of_variant("v")).alias("plain"), R.document_shape(F.col("v")).alias("shape"))
    got = told.orderBy("i").collect()
    assert all(not r["shape"] for r in got if r["plain"])
    assert [r["plain"] for r in got[: len(plain)]] == [True] * len(plain)
    assert not any(r["plain"] for r in got[len(plain) : len(plain) + len(hidden)])


def test_non_finite_numbers_are_found_beside_other_types(spark):
    mixed = '{"bands": [1e999, "x"], "n": 1}'
    texts = [json.dumps(result(analyzers=[analyzer(raw_metrics=0)])).replace('"raw_metrics": 0', f'"raw_metrics": {m}') for m in (mixed, '{"a": [{"b": 2E+400}]}', '{"a": "1e999"}')]
    assert judged(spark, texts) == [["R01"], ["R01"], []]


def compact(doc, **options):
    return json.dumps(doc, separators=(",", ":"), **options)


def test_plain_texts_are_judged_as_parsed_ones(spark):
    """A text in the model's order is told from one pattern; spaces send the same document the long way round."""
    from mediasift import schemas

    many = [analyzer(analyzer_id=f"a{i}", errors=[ERROR] * (i % 3), warnings=["w", "ä一\U0001f600", 'q"\\\n\t'][: i % 4]) for i in range(3000)]
    places = [{"type": "file"}, {"type": "time_interval", "start_seconds": 0, "end_seconds": 1.5}, {"type": "frame_interval", "start_frame": 3, "end_frame": 2}, None]
    plain = [result(analyzers=many), result(findings=[finding(finding_id=str(i), localization=p, source_score=-2.5e-7) for i, p in enumerate(places)]), partial(), rejected()]
    docs = [*plain, *GOOD, *[doc for doc, _ in BAD if not isinstance(doc, str)]]
    texts = [compact(d, ensure_ascii=a) for d in docs for a in (False, True)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, doc string")
    told = [r["plain"] for r in rows.select("i", R.is_plain_text(F.col("doc")).alias("plain")).orderBy("i").collect()]
    assert all(told[: 2 * len(plain)])
    assert judged(spark, texts) == judged(spark, [d for d in docs for _ in range(2)])
    narrow = results.judge(rows, typed_as=schemas.JUDGED).orderBy("i")
    assert [r["violations"] for r in narrow.collect()] == judged(spark, texts)


def test_texts_that_only_look_plain(spark):
    text = compact(result(analyzers=[analyzer(summary="s")], warnings=["w"]))
    odd = [
        text.replace('"warnings":["w"]', '"warnings":["w",]'), text[:-1] + ",}", text + " ", text + "x", text[:-1], text.replace('"s"', '"\x01"'),
        text.replace('"s"', '"\\x"'), text.replace('"s"', '"\\u12"'), text.replace('"score":null', '"score":01'), text.replace('"score":null', '"score":1e999'),
        text.replace('"score":null', '"score":1.'), text.replace('"score":null', '"score":NaN'), text.replace('"applicable":false', '"applicable":null'),
        text.replace('"summary":"s"', '"summary":"s","summary":"t"'), text.replace('"stage":', '"stage":"x","stage":'), text.replace('"size_bytes":0', '"size_bytes":0.0'),
        text.replace('"size_bytes":0', f'"size_bytes":{10**30}'), text.replace('"raw_metrics":{}', '"raw_metrics":{"a":1,"a":2}'),
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([text, *odd])], "i int, doc string")
    told = [r["p"] for r in rows.select("i", R.is_plain_text(F.col("doc")).alias("p")).orderBy("i").collect()]
    assert told == [True] + [False] * len(odd)
    spaced = [t.replace(":", ": ", 1) for t in odd]
    assert judged(spark, odd) == judged(spark, spaced)
    broken = rows.limit(1).select(F.replace(F.lit(text).cast("binary").cast("string"), F.lit('"s"'), F.unhex(F.lit("22FF22")).cast("string")).alias("doc"))
    assert results.judge(broken).first()["violations"] == ["UTF8"]


def test_unknown_fields_beside_plain_ones(spark):
    text = compact(result())
    with_extra = [
        '{"extra":1,' + text[1:], text[:-1] + ',"extra":"x","b":null}', text.replace('"findings":', '"zz":true,"findings":'),
        '{"b":-1.5,' + text[1:-1] + ',"extra":1}',
    ]
    rows = spark.createDataFrame([(t,) for t in with_extra], "doc string")
    assert rows.where(R.is_plain_beside_unknown(F.col("doc"))).count() == len(with_extra)
    names = [["extra"], ["b", "extra"], ["zz"], ["b", "extra"]]
    assert judged(spark, with_extra) == [[f"R03:result.{n}" for n in found] for found in names]
    assert judged(spark, with_extra) == judged(spark, [t.replace(":", ": ", 1) for t in with_extra])
    assert judged(spark, with_extra, Params(strict_fields=False)) == [[]] * len(with_extra)
    twice = ['{"extra":1,"extra":2,' + text[1:], '{"stage":"x",' + text[1:], '{"extra":{},' + text[1:]]
    assert judged(spark, twice) == [["JSON"], ["JSON"], ["R03:result.extra"]]


def test_built_documents_are_plain_texts(spark):
    """Each was parsed to a variant, described and opened before it was typed."""
    from mediasift.plans import assess_queries as Q

    docs = Q.result_documents(spark, "/root/testdata/sf0.001")
    assert docs.where(~R.is_plain_text(F.col("doc"))).count() == 0
