import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediasift import Params, schemas
from mediasift.operators import analyzers, assess, findings, grids
from mediasift.sources import results

import documents as D

FINDING = "analysis_id string, finding_id string, severity string, type string, correlation_group string, critical_override_eligible boolean"


def test_counters_follow_the_applicable_column(spark):
    rows = [("a", "completed", True)] * 3 + [("a", "error", True), ("a", "skipped", False)]
    rows += [("b", "not_applicable", False)] + [("c", "completed", True)] * 2
    rows += [("d", "completed", True), ("d", "timeout", True)] + [("e", "error", True)]
    df = spark.createDataFrame(rows, "analysis_id string, status string, applicable boolean")
    got = {r["analysis_id"]: r for r in assess.completeness(df).collect()}
    a = got["a"]
    assert [a[f"{n}_analyzers"] for n in ("planned", "applicable", "completed", "failed", "skipped")] == [5, 4, 3, 1, 1]
    assert (a["coverage_ratio"], a["completeness_status"]) == (0.75, "partial")
    assert {k: v["completeness_status"] for k, v in got.items()} == {
        "a": "partial", "b": "insufficient", "c": "complete", "d": "partial", "e": "insufficient",
    }


def test_scores_and_levels(spark):
    rows = [
        ("a", "1", "significant", "x", "g", False), ("a", "2", "weak", "x", "g", False), ("a", "3", "weak", "x", None, False),
        ("a", "4", "weak", "x", None, False), ("b", "1", "critical", "splice", None, True), ("c", "1", "critical", "other", "g", True),
    ]
    df = spark.createDataFrame(rows, FINDING)
    policy = Params(override_enabled=True, override_finding_types=("splice",))
    got = {r["analysis_id"]: (r["score"], r["n_override_findings"]) for r in assess.risk_scores(df, policy).collect()}
    assert got == {"a": (35.0, 0), "b": (0.0, 1), "c": (0.0, 0)}
    assert {r["n_override_findings"] for r in assess.risk_scores(df).collect()} == {0}
    levels = spark.createDataFrame([(29.0,), (29.5,), (60.0,), (60.5,), (None,)], "s double").coalesce(1)
    assert [r[0] for r in levels.select(assess.level_of(F.col("s"), Params())).collect()] == ["low", "medium", "medium", "high", None]


def test_no_level_without_coverage(spark):
    runs = spark.createDataFrame(
        [("a", "completed", True), ("b", "error", True), ("c", "completed", True)], "analysis_id string, status string, applicable boolean"
    )
    rows = [("a", "1", "critical", "splice", None, True), ("b", "1", "critical", "splice", None, True)]
    policy = Params(override_enabled=True, override_finding_types=("splice",))
    out = assess.recommend(assess.assess(assess.completeness(runs, policy), spark.createDataFrame(rows, FINDING), policy))
    got = {r["analysis_id"]: (r["score_based_level"], r["final_level"], r["critical_override_applied"], r["primary_action"]) for r in out.collect()}
    assert got == {
        "a": ("low", "high", True, "escalate_to_security"), "b": (None, None, False, "request_better_quality_source"),
        "c": ("low", "low", False, "no_additional_action"),
    }
    assert {r["probability"] for r in out.collect()} == {None}


@pytest.mark.parametrize("n", [20, 2000])
def test_documents_have_one_form_at_any_size(spark, n):
    heads = spark.createDataFrame([("hot",), ("small",), ("bare",)], "analysis_id string").withColumn(
        "risk_assessment", F.struct(F.lit("high").alias("final_level"), F.array().cast("array<string>").alias("critical_finding_ids"))
    ).withColumn("first_override_finding", F.when(F.col("analysis_id") == "hot", "f0000"))
    found = spark.range(n).select(
        F.when(F.col("id") < n - 10, "hot").otherwise("small").alias("analysis_id"),
        F.format_string("f%04d", "id").alias("finding_id"), (F.col("id") % 5 == 0).alias("_critical"),
    )
    runs = spark.createDataFrame([("hot", "a1"), ("small", "a1")], "analysis_id string, analyzer_id string")
    docs = {r["analysis_id"]: json.loads(r["doc"]) for r in assess.assemble(heads, runs, found).collect()}
    ids = [f"f{i:04d}" for i in range(n - 10)]
    assert [f["finding_id"] for f in docs["hot"]["findings"]] == ids
    assert docs["hot"]["risk_assessment"]["critical_finding_ids"] == ids[::5]
    assert len(docs["small"]["findings"]) == 10 and (docs["bare"]["findings"], docs["bare"]["analyzers"]) == ([], [])
    rows = assess.document_rows(heads, runs, found).collect()
    assert len(rows) == 3 + 2 + n
    assert sorted(r["child_id"] for r in rows if r["critical"] and r["analysis_id"] == "hot") == ids[::5]
    long = {r["child_id"]: json.loads(r["json"]) for r in rows if (r["analysis_id"], r["section"]) == ("hot", "findings")}
    assert [long[i] for i in ids] == docs["hot"]["findings"]


def test_flatten_and_references(spark):
    found = [D.finding(finding_id="x", source_analyzer_id="n"), D.finding(finding_id="y", source_analyzer_id="n", source_analyzer_version="2")]
    doc = D.result(analyzers=[D.analyzer(analyzer_id="n")], findings=found)
    typed = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(F.from_json("doc", schemas.RESULT).alias("result"))
    flat = findings.flatten_array(typed, "findings")
    assert [(r["pos"], r["finding_id"]) for r in flat.collect()] == [(0, "x"), (1, "y")]
    orphans = findings.orphan_sources(flat, findings.flatten_array(typed, "analyzers"))
    assert [(r["source_analyzer_version"], r["n_findings"]) for r in orphans.collect()] == [("2", 1)]
    assert findings.flatten_array(typed, "errors").count() == 0
    claims = spark.createDataFrame([(doc["analysis_id"], ["x", "z"])], "analysis_id string, critical_finding_ids array<string>")
    assert [r["finding_id"] for r in findings.dangling_critical_ids(claims, flat).collect()] == ["z"]


def test_result_status(spark):
    rows = [("rejected", "complete"), ("failed", "complete"), ("accepted", "complete"), ("accepted", "partial"), ("accepted", "insufficient")]
    df = spark.createDataFrame(rows, "o string, c string").coalesce(1)
    got = [r[0] for r in df.select(assess.result_status(F.col("o"), F.col("c"))).collect()]
    assert got == ["rejected", "failed", "completed", "partial", "failed"]


def media(spark, *rows):
    return spark.createDataFrame(rows, "analysis_id string, media_type string, duration_seconds double, has_audio boolean, size_bytes bigint, sha256 string")


def test_grids(spark):
    df = media(
        spark, ("a", "audio", 25.0, True, 1, "s"), ("b", "audio", 20.0, True, 1, "s"), ("c", "video", 4.5, True, 1, "s"),
        ("d", "image", None, False, 1, "s"), ("e", "audio", 0.25, True, 1, "s"), ("z", "audio", None, True, 1, "s"),
    )
    cut = {}
    for r in grids.audio_fragments(df).orderBy("analysis_id", "fragment").collect():
        cut.setdefault(r["analysis_id"], []).append((r["start_seconds"], r["end_seconds"]))
    assert cut == {"a": [(0, 10), (10, 20), (20, 25)], "b": [(0, 10), (10, 20)], "e": [(0, 0.25)]}
    assert [r["at_seconds"] for r in grids.video_keyframes(df).orderBy("keyframe").collect()] == [0, 2, 4]
    kinds = {r[0] for r in grids.artifact_catalog(df).select("artifact_type").collect()}
    assert kinds == set(assess.dims.vocab.ARTIFACT_TYPES)
    few = grids.artifact_catalog(df, Params(build_spectrogram=False, extract_metadata=False))
    assert "spectrogram" not in {r[0] for r in few.select("artifact_type").collect()}
    for params in (Params(), Params(build_spectrogram=False, extract_metadata=False, keyframe_seconds=3)):
        odd = df.unionAll(media(spark, ("n", "audio", -3.0, None, 1, "s"), ("v", "video", 0.0, None, 1, "s"), ("u", None, 9.0, True, 1, "s")))
        counts = odd.select(F.size(grids.artifacts(params)).alias("made"), grids.artifact_count(params).alias("reckoned")).collect()
        assert all(r["made"] == r["reckoned"] for r in counts) and len(counts) == 9


def test_one_failing_row_does_not_stop_the_others(spark):
    def analyze(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["size_bytes"] == 3).any():
            raise RuntimeError("secret detail")
        n = len(rows)
        return pd.DataFrame({"score": [0.5] * n, "score_name": ["p"] * n, "summary": ["ok"] * n, "raw_metrics": ["{}"] * n, "candidate_findings": [["{}"]] * n})

    def wrong_length(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": []})

    asked = spark.createDataFrame(
        [(f"m{i}", a, "1", "image", "g", i) for i in range(6) for a in ("good", "short", "absent")] + [("m9", "good", "2", "image", "g", 1)],
        "analysis_id string, analyzer_id string, analyzer_version string, media_type string, `group` string, size_bytes bigint",
    )
    registry = {
        "good": analyzers.Analyzer("good", "1", "image", "g", analyze),
        "short": analyzers.Analyzer("short", "1", "image", "g", wrong_length),
    }
    out = analyzers.run(asked, registry).collect()
    assert len(out) == 19 and next(r for r in out if r["analysis_id"] == "m9")["error_code"] == "analyzer_failed"
    status = {(r["analysis_id"], r["analyzer_id"]): r["status"] for r in out}
    assert {k for k, v in status.items() if v == "completed"} == {(f"m{i}", "good") for i in range(6) if i != 3}
    bad = next(r for r in out if (r["analysis_id"], r["analyzer_id"]) == ("m3", "good"))
    assert bad["score"] is None and bad["error_code"] == "analyzer_failed" and "secret" not in bad["summary"]


def test_hanging_and_declined_rows_cost_only_themselves(spark):
    def analyze(rows: pd.DataFrame) -> pd.DataFrame:
        import time

        while (rows["size_bytes"] == 3).any():
            try:
                time.sleep(60)
            except Exception:  # swallows what it can
                pass
        assert not rows["size_bytes"].isin([1, 4]).any()
        n = len(rows)
        return pd.DataFrame({"score": rows["size_bytes"].astype("float64").tolist(), "score_name": ["p"] * n, "summary": ["ok"] * n, "raw_metrics": ["{}"] * n, "candidate_findings": [["{}"]] * n})

    asked = spark.createDataFrame(
        [(f"m{i}", "slow", "1", "image", "g", i, 1) for i in range(6)] + [("m4", "never", "1", "image", "g", 4, None)],
        "analysis_id string, analyzer_id string, analyzer_version string, media_type string, `group` string, size_bytes bigint, limit_seconds int",
    ).coalesce(1)
    registry = {
        "slow": analyzers.Analyzer("slow", "1", "image", "g", analyze, lambda rows: ~rows["size_bytes"].isin([1, 4])),
        "never": analyzers.Analyzer("never", "1", "image", "g", analyze, lambda rows: [False] * len(rows)),
    }
    out = {(r["analyzer_id"], r["analysis_id"]): (r["status"], r["applicable"], r["score"], r["error_code"]) for r in analyzers.run(asked, registry).collect()}
    declined = ("not_applicable", False, None, None)
    want = {("slow", f"m{i}"): ("completed", True, float(i), None) for i in (0, 2, 5)}
    want |= {("slow", "m1"): declined, ("slow", "m4"): declined, ("never", "m4"): declined}
    assert out == want | {("slow", "m3"): ("timeout", True, None, "analyzer_timeout")}


@pytest.mark.parametrize("bad", ["not json", "{}"])
def test_unusable_candidates_still_name_their_source(spark, bad):
    df = spark.createDataFrame([("a", "n", "1", "g", 0.5, [bad])], "analysis_id string, analyzer_id string, analyzer_version string, `group` string, score double, candidate_findings array<string>")
    row = findings.form_findings(df).first()
    assert (row["source_analyzer_id"], row["severity"], row["localization"]) == ("n", None, None)


def test_judge_documents_of_assessment(spark):
    df = spark.createDataFrame([(json.dumps(D.result()),)], "doc string")
    assert results.judge(df).first()["violations"] == []


@pytest.mark.parametrize("name", ["assemble", "flatten_findings", "documents_valid"])
def test_documents_shuffle_bare_columns_only(spark, name):
    """The JSON text of every child went through a shuffle, and each grouping and join by analysis through one more."""
    from mediasift.plans import assess_queries as Q

    plan = Q.result_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 4 and all("cast(l_orderkey" in line for line in dealt)
    asked = getattr(Q, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("analysis_id" in line or "json" in line for line in asked.splitlines() if "Exchange hashpartitioning" in line)
