"""Rules that cases and manifests of a dataset must keep; each breach is a row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.sources.schemas import TASK_TYPES

# Licences under which text may be shipped, those that ask for attribution, sizes of tiers, what a case's
# provenance must say, and the metrics that fit a task.
LICENSES = ("CC0-1.0", "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0")
NEED_ATTRIBUTION = ("CC-BY-4.0", "CC-BY-SA-4.0")
TIERS = {"smoke": (5, 20), "ci": (50, 200), "nightly": (500, 2000), "release": (1, None)}
PROVENANCE = ("source_id", "source_record_id", "source_revision", "adapter_name", "adapter_version")
FITTING_METRICS = {
    "qa_short": ("squad_f1", "exact_match", "numeric_assertion"),
    "classification": ("classification",),
    "extraction": ("json_validity", "json_field_f1"),
    "summarization": ("rouge_l", "chrf_pp", "meteor"),
    "retrieval": ("retrieval_ndcg_10", "retrieval_precision_at_k", "retrieval_mrr", "retrieval_map"),
}


def versioned_rules(provenance: Column, task: Column, metrics: Sequence[str]) -> dict[str, Column]:
    """Rules of packs with a schema version: where each case comes from, and that one of the pack's metrics fits its task."""
    told = F.array(*(F.coalesce(F.btrim(F.try_element_at(provenance, F.lit(k))), F.lit("")) for k in PROVENANCE))
    unfit = [task for task, fitting in FITTING_METRICS.items() if not set(fitting) & set(metrics)]
    return {"no_provenance": F.exists(told, lambda x: x == ""), "no_fitting_metric": task.isin(*unfit) if unfit else F.lit(False)}


def breaches(cases: DataFrame, case_id: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, case_id): one row a rule that a case breaks, all rules in one pass; a rule that is null isn't broken."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return cases.select(F.explode(broken).alias("rule"), F.col(case_id).alias("case_id"))


def repeated(cases: DataFrame, key: Column, case_id: str, rule: str) -> DataFrame:
    """(rule, case_id): cases whose key others have too."""
    k = cases.select(key.alias("k"), F.col(case_id).alias("case_id"))
    many = k.groupBy("k").agg(F.count_distinct("case_id").alias("n")).where("n > 1").select("k")
    return k.join(many, "k", "left_semi").select(F.lit(rule).alias("rule"), "case_id").distinct()


# What a case of each task must have.
NEEDED = {
    "classification": ("expected_label",), "extraction": ("expected_json",), "summarization": ("reference_answer",), "qa_short": ("reference_answer",),
    "retrieval": ("qrels",), "rag": ("reference_answer", "qrels"), "tool_use": ("expected_json",),
}


def missing_fields(cases: DataFrame) -> Column:
    """Whether a case lacks a field that its task needs; a column that the table doesn't have is lacking everywhere."""
    lacks = lambda c: F.col(c).isNull() if c in cases.columns else F.lit(True)
    out = F.lit(False)
    for task, fields in NEEDED.items():
        out = F.when(F.col("task_type") == task, F.greatest(*(lacks(c) for c in fields)) if len(fields) > 1 else lacks(fields[0])).otherwise(out)
    return out


def json_texts(inputs: str) -> Column:
    """All texts of a column of maps, structs, arrays or JSON, however deep: the strings of its JSON, an escape counting as the one character it stands for."""
    text = F.regexp_replace(F.to_json(F.struct(F.col(inputs).alias("x"))), r"\\u[0-9a-fA-F]{4}|\\.", "x")
    return F.regexp_extract_all(F.regexp_replace(text, r'"[^"]*+"\s*:', ""), F.lit(r'"([^"]*+)"'), F.lit(1))


def case_rules(inputs: Column, reference: Column, weight: Column, slices: Column, task: Column, declared: Sequence[str], input_limit: int = 2000, reference_limit: int = 500, needed: Column | None = None, texts: Column | None = None) -> dict[str, Column]:
    """The rules of a case. needed: whether a field is missing that its task needs (missing_fields), by default whether it has no reference; texts: the texts of its inputs, each of which is bounded, by default the inputs as one."""
    return {
        "unknown_task": ~task.isin(*TASK_TYPES),
        "no_inputs": inputs.isNull() | (F.btrim(inputs) == ""),
        "no_reference": needed if needed is not None else reference.isNull() | (reference == ""),
        "inputs_too_long": F.length(inputs) > input_limit if texts is None else F.exists(texts, lambda x: F.length(x) > input_limit),
        "reference_too_long": F.length(reference) > reference_limit,
        "weight_not_positive": weight <= 0,
        "undeclared_slices": F.size(F.array_except(F.array(*(F.lit(x) for x in declared)), F.coalesce(F.map_keys(slices), F.array().cast("array<string>")))) > 0,
    }


def manifest_errors(manifest: dict, n_cases: int, content_sha256: str, committed: bool = False, allow_holdout: bool = False) -> list[str]:
    """What a manifest gets wrong about itself and its cases."""
    out, source = [], manifest.get("source") or {}
    if committed or source.get("redistributable_smoke"):
        if manifest["license"] not in LICENSES:
            out.append(f"license {manifest['license']} may not be shipped")
        if manifest["license"] in NEED_ATTRIBUTION and not str(source.get("attribution") or "").strip():
            out.append("the license needs source.attribution")
    if manifest.get("content_sha256") not in (None, content_sha256):
        out.append("content_sha256 doesn't match the cases")
    if manifest["split"] == "holdout" and not allow_holdout:
        out.append("a holdout split must be allowed explicitly")
    if "schema_version" in manifest:
        low, high = TIERS[manifest["tier"]]
        if n_cases < low or high is not None and n_cases > high:
            out.append(f"tier {manifest['tier']} holds {low} to {high or 'any number of'} cases, not {n_cases}")
        if manifest["adapter"].get("sample_size") != n_cases:
            out.append("adapter.sample_size isn't the number of cases")
        if (manifest["tier"] == "release") != (manifest["split"] == "holdout"):
            out.append("the release tier and the holdout split belong together")
        if not re.fullmatch(r"sha256:[0-9a-f]{64}", str(source.get("revision_digest"))):
            out.append("source.revision_digest must be sha256: and 64 hex digits")
        if "://" not in str(source.get("canonical_url")):
            out.append("source.canonical_url must be absolute")
        if manifest["pii_scrubbed"] and not str(manifest["pii_scrub_procedure"] or "").strip():
            out.append("pii_scrubbed needs pii_scrub_procedure")
    return out


def jailed(base: str, declared: str) -> Path:
    """The declared path within base; one that leads out of it is an error."""
    root = Path(base).resolve()
    path = (root / declared).resolve()
    if Path(declared).is_absolute() or root not in (path, *path.parents):
        raise ValueError(f"{declared} leads out of {base}")
    return path
