"""Policies: what a file must say, and each kind of gate on both sides of its bound."""

import json

import pytest

from verdigrade import pipeline
from verdigrade.operators import gates

ALL = [
    {"name": "c", "kind": "coverage", "severity": "blocking", "min_coverage": 0.9}, {"name": "h", "kind": "harness_failure_rate", "severity": "blocking", "max_rate": 0.1},
    {"name": "p", "kind": "paired_regression", "severity": "blocking", "min_abs_effect": 0.02, "max_p_value": 0.05}, {"name": "q", "kind": "quality_floor", "severity": "blocking", "metric": "exact_match", "min_value": 0.5},
    {"name": "j", "kind": "calibrated_judge", "severity": "blocking", "min_agreement": 0.8}, {"name": "l", "kind": "latency", "severity": "informational", "max_p95_ms": 100}, {"name": "u", "kind": "cost", "severity": "blocking", "max_usd": 5},
]
RUN = {"run_status": "completed", "coverage": 0.95, "coverage_floor": 0.98, "harness_failures": 1, "planned_generations": 20, "cost_usd_total": 4.0, "cost_unpriced_generations": 0, "latency_ms": {"p95": 80}, "metric_aggregates": [{"metric": "exact_match", "slice": "__overall__", "value": 0.6}, {"metric": "exact_match", "slice": "a=b", "value": 0.1}]}
COMPARE = {"result": {"absolute_delta": -0.01, "cohens_h": -0.02, "p_value": 0.01, "significant_bh": True}}
CALIBRATION = {"gating_allowed": True, "holdout": {"agreement": 0.9}, "block_reasons": []}


def policy(*items, **artifacts):
    return {"schema_version": "0.1", "name": "x", "artifacts": artifacts or {"run_report": "run.json", "compare": "compare.json", "calibration": "cal.json"}, "gates": list(items or ALL)}


def check(spark, tmp_path, run=(), compare=(), calibration=(), items=ALL):
    files = {"gates.yaml": policy(*items), "run.json": RUN | dict(run), "compare.json": {"result": COMPARE["result"] | dict(compare)}, "cal.json": CALIBRATION | dict(calibration)}
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    return pipeline.gates_from_file(spark, str(tmp_path / "gates.yaml"))


def failed(result):
    return {r["gate"] for r in result["results"] if not r["passed"]}


def test_all_hold(spark, tmp_path):
    r = check(spark, tmp_path)
    assert failed(r) == set() and not r["blocking_failed"] and not r["informational_failed"] and len(r["results"]) == 7


@pytest.mark.parametrize(
    "change,want",
    [
        ({"run": {"coverage": 0.8}}, {"c"}), ({"run": {"run_status": "partial"}}, {"c"}), ({"run": {"harness_failures": 3}}, {"h"}), ({"run": {"planned_generations": 0}}, {"h"}), ({"compare": {"absolute_delta": -0.05}}, {"p"}),
        ({"compare": {"absolute_delta": 0.05}}, set()), ({"compare": {"absolute_delta": -0.05, "p_value": 0.2}}, set()), ({"run": {"metric_aggregates": []}}, {"q"}), ({"calibration": {"gating_allowed": False}}, {"j"}),
        ({"calibration": {"holdout": {"agreement": None}}}, {"j"}), ({"run": {"latency_ms": {}}}, {"l"}), ({"run": {"latency_ms": {"p95": 101.5}}}, {"l"}), ({"run": {"cost_unpriced_generations": 1}}, {"u"}), ({"run": {"cost_usd_total": 5.5}}, {"u"}),
    ],
)
def test_each_gate(spark, tmp_path, change, want):
    r = check(spark, tmp_path, **change)
    assert failed(r) == want and r["blocking_failed"] == bool(want - {"l"}) and r["informational_failed"] == ("l" in want)
    assert all((x["reason"] == "holds") == x["passed"] for x in r["results"])


def test_floor_of_the_report_and_effect_size(spark, tmp_path):
    items = [{"name": "c", "kind": "coverage", "severity": "informational"}, {"name": "p", "kind": "paired_regression", "severity": "blocking", "min_abs_effect": 0.0, "min_cohens_h": 0.1}]
    assert failed(check(spark, tmp_path, items=items)) == {"c"}
    assert failed(check(spark, tmp_path, items=items, compare={"cohens_h": -0.2})) == {"c", "p"}
    assert failed(check(spark, tmp_path, items=items, compare={"cohens_h": -0.2, "significant_bh": False})) == {"c"}


@pytest.mark.parametrize(
    "bad,code",
    [
        ([], "INVALID_MANIFEST"), (policy() | {"schema_version": "9"}, "UNSUPPORTED_SCHEMA"), (policy(ALL[0], ALL[0]), "INVALID_MANIFEST"), (policy({**ALL[0], "kind": "other"}), "INVALID_MANIFEST"), (policy({**ALL[0], "more": 1}), "INVALID_MANIFEST"),
        (policy({**ALL[1], "max_rate": 2}), "INVALID_MANIFEST"), (policy({**ALL[1], "max_rate": True}), "INVALID_MANIFEST"), (policy({**ALL[5], "max_p95_ms": -1}), "INVALID_MANIFEST"), (policy({"name": "h", "kind": "harness_failure_rate", "severity": "blocking"}), "INVALID_MANIFEST"),
        (policy(ALL[2], run_report="run.json"), "INVALID_MANIFEST"), (policy(ALL[0], run_report="../run.json"), "ARTIFACT_OUTSIDE_GATES"), (policy(ALL[0], run_report="nowhere.json"), "MISSING_ARTIFACT"),
    ],
)
def test_bad_policies(tmp_path, bad, code):
    (tmp_path / "gates.yaml").write_text(json.dumps(bad))
    with pytest.raises(gates.GateError) as e:
        gates.load(str(tmp_path / "gates.yaml"))
    assert e.value.code == code


def test_bad_artifacts_and_overrides(spark, tmp_path):
    (tmp_path / "gates.yaml").write_text(json.dumps(policy(ALL[0], run_report="run.json")))
    (tmp_path / "run.json").write_text("{")
    with pytest.raises(gates.GateError, match="INVALID_ARTIFACT"):
        gates.load(str(tmp_path / "gates.yaml"))
    (tmp_path / "other.json").write_text(json.dumps(RUN))
    assert not pipeline.gates_from_file(spark, str(tmp_path / "gates.yaml"), {"run_report": str(tmp_path / "other.json")})["blocking_failed"]
    (tmp_path / "other.json").write_text(json.dumps({"coverage": 1}))
    with pytest.raises(gates.GateError, match="INVALID_ARTIFACT"):
        pipeline.gates_from_file(spark, str(tmp_path / "gates.yaml"), {"run_report": str(tmp_path / "other.json")})


def test_yaml(tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(RUN))
    (tmp_path / "gates.yaml").write_text("schema_version: '0.1'\nname: x\nartifacts: {run_report: run.json}\ngates:\n- {name: c, kind: coverage, severity: blocking}\n")
    pytest.importorskip("yaml")
    assert gates.load(str(tmp_path / "gates.yaml"))[1][0].name == "c"
