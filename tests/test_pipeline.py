"""From a pack to a gated suite on the mock model."""

import json

import pytest
from pyspark.sql import functions as F

from verdigrade import pipeline as pl


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"c{i}", "qa_short", {"question": f"What is {i} plus one?"}, str(i + 1 if i % 5 else 0), {"parity": "even" if i % 2 == 0 else "odd"}) for i in range(10)]
    return spark.createDataFrame(rows, "id string, task_type string, inputs map<string,string>, reference_answer string, slices map<string,string>")


def test_run_to_suite(spark, cases, tmp_path):
    store = str(tmp_path / "store")
    a = pl.run(spark, store, cases, "{{ question }}", 2, run_id="00000000-0000-4000-8000-000000000001")
    assert pl.run(spark, store, cases, "{{ question }}", 2, run_id=a) == a
    assert spark.read.parquet(f"{store}/generations").count() == 20
    b = pl.run(spark, store, cases, "{{ question }} Really?", 2, run_id="00000000-0000-4000-8000-000000000002")
    reports = []
    for r in (a, b):
        agg = {(x.metric, x.slice): x for x in pl.rescore(spark, store, cases, r, ["exact_match", "squad_f1", "retrieval_mrr"]).collect()}
        assert agg[("exact_match", "__overall__")].value == pytest.approx(0.8) and agg[("retrieval_mrr", "__overall__")].n == 0 and ("exact_match", "parity=odd") in agg
        pl.rescore(spark, store, cases, r, ["exact_match"])
        reports.append(pl.report(spark, store, r, 20, str(tmp_path / r)))
    assert spark.read.parquet(f"{store}/scores").count() == 2 * 20 * 3
    assert reports[0]["summary"][0]["publishable"] and reports[0]["examples"][0]["passed"] is False
    assert {p.name for p in (tmp_path / a).iterdir()} == {"report.json", "report.html", "report.xml"}
    c = pl.compare_runs(spark, store, a, b, "exact_match")
    assert (c["n"], c["delta"], c["p_value"], c["n_flaky"]) == (20, 0.0, 1.0, 0) and c["ci_low"] == c["ci_high"] == 0.0
    s = pl.suite_build(spark, reports, {a: "exact_match", b: "exact_match"}, str(tmp_path / "suite"))
    assert len(s["leaderboard"]) == 2 and len(s["failures"]) == 8 and pl.suite_validate(s) and not pl.suite_validate(s | {"name": "forged"})
    assert json.loads((tmp_path / "suite" / "suite.json").read_text())["suite_digest"] == s["suite_digest"]
    matrix = {"models": [{"id": "m", "model": "x"}], "prompts": [{"id": "p"}], "datasets": [{"id": "d"}], "cells": [{"id": "1", "model": "m", "prompt": "p", "dataset": "d"}], "repeats": 1}
    assert len(pl.matrix_validate(matrix)) == 64
    base = pl.baseline_promote(matrix, None, "1", reports[0])
    assert pl.baseline_validate(base, matrix, {a: reports[0]}) == [] and len(pl.baseline_validate(base, matrix | {"repeats": 2}, {})) == 2
    for bad in ({"models": [{"id": "m", "model": "Latest"}]}, {"cells": [{"id": "1", "model": "z", "prompt": "p", "dataset": "d"}]}, {"prompts": []}, {"repeats": 0}):
        with pytest.raises(ValueError):
            pl.matrix_validate(matrix | bad)


def test_supplied_rows_and_metrics(spark):
    df = spark.createDataFrame([(1, "The 5", "5"), (2, None, "x"), (3, "y", None)], "id int, output string, reference string")
    got = {(r.id, r.metric): r.value for r in pl.score(df, ["exact_match", "numeric_assertion"]).collect()}
    assert got == {(1, "exact_match"): 1.0, (1, "numeric_assertion"): 1.0, (2, "exact_match"): None, (2, "numeric_assertion"): None, (3, "exact_match"): None, (3, "numeric_assertion"): None}
    assert len(pl.metrics_list()) == 16 and pl.power(0.5, 0.1) > 300


def test_calibrate(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.3), (False, 0.1)], "correct boolean, confidence double")
    c = pl.calibrate(df)
    assert c["roc_auc"] == 1.0 and c["pr_auc"] == 1.0 and c["threshold"] == 0.8 and c["accuracy_at"] == pytest.approx(0.5)


def test_materialize_and_validate(spark, tmp_path):
    src = tmp_path / "s.jsonl"
    src.write_text("".join(json.dumps({"id": f"x{i}", "document": f"text {i}", "summary": "s"}) + "\n" for i in range(20)))
    m = {"name": "n", "version": "1.0.0", "split": "test", "license": "MIT", "pii_scrubbed": False, "created_at": "2025-01-01", "slices": []}
    packs = [pl.dataset_materialize(spark, "summaries", str(src), str(tmp_path / f"p{i}"), 3, 5, m) for i in (1, 2)]
    assert packs[0] == packs[1] and (tmp_path / "p1" / "cases.jsonl").read_bytes() == (tmp_path / "p2" / "cases.jsonl").read_bytes()
    from verdigrade.sources import datasets as ds

    manifest = ds.read_manifest(str(tmp_path / "p1"))
    assert manifest["content_sha256"] == ds.content_sha256(spark, str(tmp_path / "p1" / "cases.jsonl"))
    errors, breaches = pl.dataset_validate(spark, str(tmp_path / "p1"))
    assert errors == [] and breaches.count() == 0
    with pytest.raises(ValueError):
        pl.dataset_materialize(spark, "summaries", str(src), str(tmp_path / "p3"), 3, 50, m)


def test_contracts(spark):
    df = spark.createDataFrame([('{"score": 3, "reasoning": "r"}',), ('```json\n{"score": 3, "reasoning": "r"}\n```',), ('{"score": 9, "reasoning": "r"}',), ('{"score": 3, "reasoning": " "}',), ("no",), (None,)], "x string")
    assert [r[0] for r in df.select(pl.pointwise_output(F.col("x"), 1, 5)).collect()] == [3, 3, None, None, None, None]
    assert spark.range(1).select(pl.pairwise_output(F.lit('{"preference": "tie", "reasoning": "r"}')), pl.nli_output(F.lit('{"label": "maybe"}'))).first()[:] == ("tie", None)
    raw = ['{"cost": 2, "usage": {"cost_usd": 3.5}}', '{"cost_usd": true}', '{"cost": -1}', "{}", "x", '{"cost": 1, "chunks": [{"cost": 4}, {"usage": {"cost": 5}}, {}]}']
    assert [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(pl.reported_cost(F.col("x"))).collect()] == [3.5, None, None, None, None, 5.0]


def test_judges(spark):
    c = spark.createDataFrame([("a", "g1"), ("b", "g2")], "case_id string, generation_id string")
    r = spark.createDataFrame([("g1", '{"score": 4, "reasoning": "ok"}'), ("g2", "?")], "generation_id string, response string")
    assert {(x.case_id, x.score) for x in pl.judge_pointwise(c, r, 1, 5).collect()} == {("a", 4), ("b", None)}
    with pytest.raises(Exception, match="response is missing"):
        pl.judge_pointwise(c, r.where("generation_id = 'g1'"), 1, 5).collect()
    pairs = spark.createDataFrame([("p1", "x", "y"), ("p2", "y", "z")], "case_id string, model_a string, model_b string")
    answers = spark.createDataFrame([(p, s, json.dumps({"preference": w, "reasoning": "r"})) for p, s, w in [("p1", 0, "A"), ("p1", 1, "B"), ("p2", 0, "A"), ("p2", 1, "A")]], "case_id string, swap int, response string")
    out = pl.judge_pairwise(pairs, answers)
    assert out["components"] == [3] and out["consistency"] == 0.5 and out["win_rates"] == {"x": 1.0, "y": 0.25, "z": 0.5}
    labels = spark.createDataFrame([(f"c{i}", str(i % 2), "holdout" if i < 30 else "dev") for i in range(60)], "case_id string, label_value string, split string")
    judged = spark.createDataFrame([(f"c{i}", i % 2 if i else 1) for i in range(60)], "case_id string, score int")
    cert = pl.judge_validate(judged, labels, "a", "b")
    assert cert["gating_allowed"] and cert["agreement"] == pytest.approx(1 - 2 / 30, abs=0.01)
    assert pl.attach_calibration({"x": 1}, cert)["gating_allowed"]
    for forged in (cert | {"agreement": 1.0}, pl.judge_validate(judged, labels, "a", "A ")):
        with pytest.raises(ValueError):
            pl.attach_calibration({}, forged)


def test_evidence(spark):
    cases = spark.createDataFrame([("a", "One is so. Two is so.", None, ["d1", "d2"], ["d1", "d9"], {"d1": 1, "d3": 1})], "case_id string, answer_text string, claims array<string>, context_ids array<string>, citations array<string>, qrels map<string,int>")
    nli = spark.createDataFrame([("a", 0, "d1", "neutral"), ("a", 0, "d1", "entailment"), ("a", 1, "d2", "contradiction")], "case_id string, claim_index int, doc_id string, label string").coalesce(1)
    assert pl.rag_evidence(cases, nli) == {"context_precision": 0.5, "context_recall": 0.5, "n_claims": 2, "unsupported_rate": 0.5, "n_citations": 2, "attribution": 0.5}
