"""Release gates: a policy file held against the reports of runs, comparisons and judge calibrations."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.rollup import OVERALL
from verdigrade.operators.validate import jailed

SCHEMA_VERSION = "0.1"
# The severities, and by kind of gate the artifact it reads, its parameters and those that may be missing.
SEVERITIES = ("blocking", "informational")
KINDS = {
    "coverage": ("run_report", {"require_completed": bool, "min_coverage": float}, {"require_completed", "min_coverage"}),
    "harness_failure_rate": ("run_report", {"max_rate": float}, set()),
    "paired_regression": ("compare", {"min_abs_effect": float, "min_cohens_h": float, "max_p_value": float}, {"min_cohens_h", "max_p_value"}),
    "quality_floor": ("run_report", {"metric": str, "min_value": float}, set()),
    "calibrated_judge": ("calibration", {"min_agreement": float}, {"min_agreement"}),
    "latency": ("run_report", {"max_p95_ms": float}, set()),
    "cost": ("run_report", {"max_usd": float}, set()),
}
SHARES = frozenset({"min_coverage", "max_rate", "max_p_value", "min_agreement"})
AT_LEAST_ZERO = SHARES | {"min_abs_effect", "min_cohens_h", "max_p95_ms", "max_usd"}

#: Columns of a row to be judged, one a release: what the three artifacts say. Those of artifacts that no gate reads may be absent.
COLUMNS = {
    "run_report": "run_status string, coverage double, coverage_floor double, harness_failures bigint, planned_generations bigint, p95_ms double, cost_usd_total double, cost_unpriced_generations bigint, quality map<string,double>",
    "compare": "absolute_delta double, cohens_h double, p_value double, significant_bh boolean",
    "calibration": "gating_allowed boolean, holdout_agreement double",
}


class GateError(ValueError):
    """A policy or artifact that can't be judged by; code says which kind of fault."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Gate:
    name: str
    kind: str
    severity: str
    given: Mapping


def parse(policy: object) -> tuple[str, list[Gate], dict[str, str]]:
    """(name, gates, artifact paths) of a policy; whatever isn't as declared is an error."""
    if not isinstance(policy, Mapping):
        raise GateError("INVALID_MANIFEST", "the policy must be a mapping")
    if policy.get("schema_version") != SCHEMA_VERSION:
        raise GateError("UNSUPPORTED_SCHEMA", f"schema_version must be {SCHEMA_VERSION}")
    artifacts = {k: v for k, v in (policy.get("artifacts") or {}).items() if v}
    if set(policy) - {"schema_version", "name", "artifacts", "gates"} or set(artifacts) - set(COLUMNS) or not policy.get("name") or not policy.get("gates"):
        raise GateError("INVALID_MANIFEST", "a policy has a name, artifacts and at least one gate, and nothing else")
    gates = []
    for g in policy["gates"]:
        kind = g.get("kind")
        if kind not in KINDS:
            raise GateError("INVALID_MANIFEST", f"unknown kind of gate {kind}")
        artifact, parameters, optional = KINDS[kind]
        given = {k: v for k, v in g.items() if k not in ("name", "kind", "severity") and v is not None}
        if not g.get("name") or g.get("severity") not in SEVERITIES or set(given) - set(parameters) or set(parameters) - optional - set(given):
            raise GateError("INVALID_MANIFEST", f"gate {g.get('name')} doesn't say what a gate of kind {kind} must")
        for k, v in given.items():
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            fits = number if parameters[k] is float else isinstance(v, parameters[k])
            if not fits or k in AT_LEAST_ZERO and v < 0 or k in SHARES and v > 1:
                raise GateError("INVALID_MANIFEST", f"gate {g['name']}: {k} can't be {v}")
        if artifact not in artifacts:
            raise GateError("INVALID_MANIFEST", f"gate {g['name']} needs the artifact {artifact}")
        gates.append(Gate(g["name"], kind, g["severity"], given))
    if len({g.name for g in gates}) < len(gates):
        raise GateError("INVALID_MANIFEST", "gate names must differ")
    return policy["name"], gates, artifacts


def load(path: str, overrides: Mapping[str, str] | None = None) -> tuple[str, list[Gate], dict]:
    """(name, gates, artifacts by kind) of a policy file (YAML, or JSON) and the artifact files it names within its folder.

    overrides: paths given by the caller in place of declared ones; they may lie anywhere.
    """
    file = Path(path)
    if not file.is_file():
        raise GateError("MISSING_ARTIFACT", path)
    text = file.read_text(encoding="utf-8")
    try:
        policy = json.loads(text)
    except ValueError:
        try:
            import yaml

            policy = yaml.safe_load(text)
        except (ImportError, ValueError) as e:
            raise GateError("INVALID_MANIFEST", f"{path}: {e}") from e
    extra = {k: v for k, v in (overrides or {}).items() if v}
    if isinstance(policy, Mapping) and extra:
        policy = {**policy, "artifacts": {**(policy.get("artifacts") or {}), **extra}}
    name, gates, paths = parse(policy)
    found = {}
    for kind, declared in paths.items():
        try:
            where = Path(extra[kind]) if kind in extra else jailed(str(file.parent), declared)
        except ValueError as e:
            raise GateError("ARTIFACT_OUTSIDE_GATES", declared) from e
        if not where.is_file():
            raise GateError("MISSING_ARTIFACT", str(where))
        try:
            found[kind] = json.loads(where.read_text(encoding="utf-8"))
        except ValueError as e:
            raise GateError("INVALID_ARTIFACT", f"{where}: {e}") from e
    return name, gates, found


def report_row(artifacts: Mapping[str, Mapping]) -> dict:
    """The columns of COLUMNS from the artifacts' JSON."""
    row: dict = {}
    try:
        if "run_report" in artifacts:
            r = artifacts["run_report"]
            row |= {c: r[c] for c in ("run_status", "coverage", "coverage_floor", "harness_failures", "planned_generations", "cost_usd_total", "cost_unpriced_generations")}
            row |= {"p95_ms": r["latency_ms"].get("p95"), "quality": {q["metric"]: q["value"] for q in r["metric_aggregates"] if q["slice"] == OVERALL}}
        if "compare" in artifacts:
            row |= {c: artifacts["compare"]["result"][c] for c in ("absolute_delta", "cohens_h", "p_value", "significant_bh")}
        if "calibration" in artifacts:
            c = artifacts["calibration"]
            row |= {"gating_allowed": c["gating_allowed"], "holdout_agreement": c["holdout"].get("agreement")}
    except (KeyError, TypeError, AttributeError) as e:
        raise GateError("INVALID_ARTIFACT", f"a field is missing: {e}") from e
    return row


def _fault(g: Gate) -> Column:
    """Why a row fails the gate, null if it doesn't; what isn't known fails, but for a regression, which must be seen."""
    x, c = g.given, F.col
    unknown_or = lambda value, bad, why: F.when(value.isNull(), f"{why} is not known").when(bad, F.concat(F.lit(f"{why} is "), value.cast("string")))
    if g.kind == "coverage":
        floor = F.lit(float(x["min_coverage"])) if "min_coverage" in x else c("coverage_floor")
        low = unknown_or(c("coverage"), ~F.coalesce(c("coverage") >= floor, F.lit(False)), "the coverage")
        return F.when(~c("run_status").eqNullSafe("completed"), "the run is not completed").otherwise(low) if x.get("require_completed", True) else low
    if g.kind == "harness_failure_rate":
        rate = F.try_divide(c("harness_failures").cast("double"), c("planned_generations"))
        return unknown_or(rate, rate > float(x["max_rate"]), "the failure rate")
    if g.kind == "quality_floor":
        value = F.try_element_at(c("quality"), F.lit(x["metric"]))
        return unknown_or(value, value < float(x["min_value"]), f"the overall {x['metric']}")
    if g.kind == "latency":
        return unknown_or(c("p95_ms"), c("p95_ms") > float(x["max_p95_ms"]), "the 95th percentile of latency")
    if g.kind == "cost":
        unpriced = F.coalesce(c("cost_unpriced_generations"), F.lit(1)) > 0
        return F.when(unpriced, "some generations have no price").otherwise(unknown_or(c("cost_usd_total"), c("cost_usd_total") > float(x["max_usd"]), "the cost"))
    if g.kind == "calibrated_judge":
        low = unknown_or(c("holdout_agreement"), c("holdout_agreement") < float(x.get("min_agreement", 0)), "the agreement on the holdout") if "min_agreement" in x else F.lit(None).cast("string")
        return F.when(~F.coalesce(c("gating_allowed"), F.lit(False)), "the calibration allows no gating").otherwise(low)
    seen = c("p_value") <= float(x["max_p_value"]) if "max_p_value" in x else c("significant_bh")
    matters = F.abs(c("absolute_delta")) >= float(x["min_abs_effect"])
    if "min_cohens_h" in x:
        matters = matters & (F.abs(c("cohens_h")) >= float(x["min_cohens_h"]))
    worse = (c("absolute_delta") < 0) & seen & matters
    return F.when(c("absolute_delta").isNull(), "the difference is not known").when(worse, F.concat(F.lit("worse by "), F.abs(c("absolute_delta")).cast("string")))


def evaluate(rows: DataFrame, gates: list[Gate], key: str) -> DataFrame:
    """(key, gate, kind, severity, passed, blocking_failure, reason): every gate held against every row, in one pass.

    rows: key and the columns of COLUMNS that the gates read. A failed gate is a row, never an error; a value
    that is null fails its gate.
    """
    parts = []
    for g in gates:
        fault = _fault(g)
        parts.append(
            F.struct(
                F.lit(g.name).alias("gate"), F.lit(g.kind).alias("kind"), F.lit(g.severity).alias("severity"), fault.isNull().alias("passed"),
                (fault.isNotNull() & F.lit(g.severity == "blocking")).alias("blocking_failure"), F.coalesce(fault, F.lit("holds")).alias("reason"),
            )
        )
    return rows.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")


def verdicts(results: DataFrame, key: str) -> DataFrame:
    """(key, blocking_failed, informational_failed): what evaluate gives, by row."""
    soft = (F.col("severity") == "informational") & ~F.col("passed")
    return results.groupBy(key).agg(F.bool_or("blocking_failure").alias("blocking_failed"), F.bool_or(soft).alias("informational_failed"))
