"""What a user calls: from datasets and models to scores, reports, comparisons, suites and gates.

Tables live as Parquet under one store folder: cases, generations and scores are insert-only by key, aggregates
are replaced by run. Generating and scoring are separate: a run is scored again without asking any model.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions import metrics as m
from verdigrade.functions import text as t
from verdigrade.functions.stats import required_sample_size
from verdigrade.operators import artifacts, calibration, compare, gates, graph, judging, plan, rag, rollup, sinks, validate
from verdigrade.session import materialize
from verdigrade.sources import datasets, providers, schemas

power = required_sample_size


def metrics_list(registry: m.Registry = m.REGISTRY) -> list[dict]:
    """Name, version, family, tasks and needed columns of every metric."""
    return [{"name": n, "version": x.version, "family": x.family, "tasks": sorted(x.tasks), "needs": list(x.needs), "threshold": x.threshold} for n in registry.names() for x in [registry.get(n)]]


# Datasets.


def dataset_validate(spark: SparkSession, path: str, committed: bool = False, allow_holdout: bool = False) -> tuple[list[str], DataFrame]:
    """(errors of the manifest, breaches of the cases)."""
    manifest, cases = datasets.read_pack(spark, path)
    errors = validate.manifest_errors(manifest, cases.count(), datasets.content_sha256(spark, f"{path}/cases.jsonl"), committed, allow_holdout)
    reference = F.coalesce("reference_answer", "expected_label", "expected_json", F.try_element_at("references", F.lit(1)))
    rules = validate.case_rules(F.to_json("inputs"), reference, F.col("weight"), F.col("slices"), F.col("task_type"), list(manifest["slices"]), needed=validate.missing_fields(cases), texts=validate.json_texts("inputs"))
    if "schema_version" in manifest:
        rules |= validate.versioned_rules(F.col("provenance"), F.col("task_type"), list(manifest["task_metrics"]))
    found = validate.breaches(cases, "id", rules)
    ids = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_id").alias("rule"), F.col("id").alias("case_id"))
    return errors, found.unionByName(ids).unionByName(validate.repeated(cases, t.prompt_key(F.col("inputs")), "id", "repeated_prompt"))


def dataset_materialize(spark: SparkSession, adapter: str, source: str, target: str, seed: int, size: int, manifest: Mapping) -> dict:
    """A pack of `size` cases drawn by seed from an adapter's file, checked and put in place as a whole."""
    rows = plan.seeded_sample(datasets.within_bounds(datasets.ADAPTERS[adapter].read(spark, source)), "id", seed, size)
    lines = [r.line for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).collect()]  # `size` rows
    if len(lines) != size:
        raise ValueError(f"only {len(lines)} cases fit, {size} are wanted")
    import hashlib

    full = dict(manifest) | {"content_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "adapter": {"name": adapter, "sample_seed": seed, "sample_size": size}}
    full["version"] = f"{full.get('version', '1.0.0')}+materialized.{artifacts.digest({k: full[k] for k in ('adapter', 'content_sha256', 'name')})[:16]}"
    sinks.write_atomic({Path(target) / "cases.jsonl": "\n".join(lines) + "\n", Path(target) / "manifest.yaml": json.dumps(full, indent=1, sort_keys=True, default=str) + "\n"})
    return full


# Runs.


def run(spark: SparkSession, store: str, cases: DataFrame, template: str, repeats: int, endpoint: providers.Endpoint | None = None, run_id: str | None = None, partitions: int = 8, call: Callable = providers.call_model, cached: bool = False) -> str:
    """Generates what a run still lacks and appends it; the same run_id goes on where it stopped. No endpoint: the mock model.

    cached: answers of earlier runs to the same prompt by the same model and parameters are taken again, at
    temperature 0 only, and new ones are kept for later; attempts is then 0.
    """
    run_id = run_id or str(uuid.uuid4())
    path = f"{store}/generations"
    done = spark.read.parquet(path).where(F.col("run_id") == run_id) if sinks._exists(spark, path) else spark.createDataFrame([], "case_id string, repeat_idx int")
    todo = plan.remaining(cases.select(F.col("id").alias("case_id")), repeats, done)
    asked = todo.join(cases.select(F.col("id").alias("case_id"), t.rendered(template, F.col("inputs")).alias("prompt")), "case_id")
    if endpoint is None:
        got = providers.mock_answers(asked, "prompt").withColumns({"finish_reason": F.lit("stop"), "completion_tokens": F.lit(1), "attempts": F.lit(1), "attempt_log": F.lit("[]")})
        got = got.withColumn("outcome", t.outcome(F.col("output"), F.col("finish_reason"), F.lit(False), F.lit(False)))
    elif cached and providers.cacheable(endpoint):
        asked = asked.withColumn("cache_key", providers.cache_key(endpoint, F.col("prompt")))
        place = f"{store}/responses"
        kept = spark.read.parquet(place) if sinks._exists(spark, place) else spark.createDataFrame([], "cache_key string, output string, outcome string, finish_reason string, prompt_tokens int, completion_tokens int, total_ms double")
        hits = asked.join(kept, "cache_key").withColumns({"attempts": F.lit(0), "attempt_log": F.lit("[]"), "ttft_ms": F.lit(None).cast("double")})
        misses = asked.join(kept.select("cache_key"), "cache_key", "left_anti")
        fresh = materialize(providers.generate(misses.repartition(partitions), "prompt", endpoint, call), "fresh-answers")
        sinks.append_first_wins(spark, place, fresh.where(~F.col("outcome").startswith("harness_")).select(*kept.columns), ["cache_key"])
        got = hits.unionByName(fresh.withColumn("ttft_ms", F.lit(None).cast("double")))
    else:
        got = providers.generate(asked.repartition(partitions), "prompt", endpoint, call).withColumn("ttft_ms", F.lit(None).cast("double"))
    columns = ("run_id", "case_id", "repeat_idx", "output", "finish_reason", "outcome", "prompt_tokens", "completion_tokens", "ttft_ms", "total_ms", "attempts", "attempt_log")
    rows = got.withColumns({"run_id": F.lit(run_id), "attempts": F.col("attempts").cast("int")}).select(*columns)
    sinks.append_first_wins(spark, path, rows, ["run_id", "case_id", "repeat_idx"])
    return run_id


def score(rows: DataFrame, names: Sequence[str], registry: m.Registry = m.REGISTRY) -> DataFrame:
    """(id, task_type, metric, value, passed) of supplied rows, nothing is stored. Columns a metric needs and the rows lack are null.

    A row of a task that a metric isn't for has no value of it.
    """
    rows = _with_defaults(rows)
    parts = []
    for n in names:
        x = registry.get(n)
        v = F.when(F.col("task_type").isin(*x.tasks) | F.lit(n == "exact_match"), x.value()).cast("double")
        parts.append(F.struct(F.lit(n).alias("metric"), v.alias("value"), (v >= x.threshold).alias("passed"), F.lit(x.threshold).alias("threshold")))
    return rows.select(*[c for c in ("id", "run_id", "case_id", "repeat_idx", "slices") if c in rows.columns], "task_type", F.explode(F.array(*parts)).alias("x")).select("*", "x.*").drop("x")


def _with_defaults(rows: DataFrame) -> DataFrame:
    kinds = {"output": "string", "reference": "string", "reference_answer": "string", "references": "array<string>", "expected_label": "string", "expected_json": "string", "qrels": "map<string,int>", "must_contain": "array<string>", "must_not_contain": "array<string>", "json_schema": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})
    rows = rows.withColumn("task_type", F.coalesce("task_type", F.lit("qa_short")) if "task_type" in rows.columns else F.lit("qa_short"))
    return rows.withColumn("reference", F.coalesce("reference", m.reference(F.col("reference_answer"), F.col("references"))))


def rescore(spark: SparkSession, store: str, cases: DataFrame, run_id: str, names: Sequence[str]) -> DataFrame:
    """Scores a stored run, appends new scores, replaces the run's aggregates and gives them."""
    g = spark.read.parquet(f"{store}/generations").where(F.col("run_id") == run_id)
    scored = score(g.join(cases.withColumnRenamed("id", "case_id").drop("output"), "case_id"), names)
    keys = ["run_id", "case_id", "repeat_idx", "metric"]
    sinks.append_first_wins(spark, f"{store}/scores", scored.select(*keys, "value", "passed"), keys)
    agg = aggregates(scored, g, cases, names)
    sinks.upsert_partitions(spark, f"{store}/aggregates", agg, ["run_id", "metric", "slice"], "run_id")
    return spark.read.parquet(f"{store}/aggregates").where(F.col("run_id") == run_id)


def aggregates(scored: DataFrame, generations: DataFrame, cases: DataFrame, names: Sequence[str], registry: m.Registry = m.REGISTRY) -> DataFrame:
    """(run_id, metric, slice, n, value, ci_low, ci_high, stddev): each metric by its own aggregate, overall and by slice."""
    dims, by = rollup.kept_dimensions(cases), {n: registry.get(n).aggregate for n in names}
    sums = [n for n in names if not callable(by[n])]
    out = rollup.score_rollup(scored.where(F.col("metric").isin(*sums)).select("run_id", "metric", "slices", "value", "threshold"), ["run_id", "metric"], dims, rates=[n for n in sums if by[n] == "rate"])
    for n in (n for n in names if callable(by[n])):
        rows = _with_defaults(generations.join(cases.withColumnRenamed("id", "case_id").drop("output"), "case_id"))
        rows = rows.where(F.col("task_type").isin(*registry.get(n).tasks)).select("run_id", "slices", *registry.get(n).needs)
        own = by[n](rollup.sliced_rows(rows, "slices", dims), ["run_id", "slice"])
        out = out.unionByName(own.select("run_id", F.lit(n).alias("metric"), "slice", "n", "value", *(F.lit(None).cast("double").alias(c) for c in ("ci_low", "ci_high", "stddev"))))
    return out


def compare_runs(spark: SparkSession, store: str, baseline: str, candidate: str, metric: str) -> dict:
    """The comparison of two runs by one metric, cases that flicker left out."""
    s = spark.read.parquet(f"{store}/scores").where(F.col("metric") == metric)
    pairs = compare.paired(s.where(F.col("run_id") == baseline), s.where(F.col("run_id") == candidate), ["case_id", "repeat_idx"])
    shaky = compare.flaky(pairs, "case_id")
    kept = pairs.join(shaky, "case_id", "left_anti")
    row = compare.compare_binary(kept).first().asDict() | {"metric": metric, "baseline": baseline, "candidate": candidate, "n_flaky": shaky.count()}
    if row["n"]:
        row |= compare.delta_interval(kept).select("ci_low", "ci_high").first().asDict()
    return row


def report(spark: SparkSession, store: str, run_id: str, planned: int, target: str | None = None, floor: float = 0.98, metric: str = "exact_match") -> dict:
    """The run's report; with a target, also as JSON, HTML and JUnit files put in place together."""
    g = spark.read.parquet(f"{store}/generations").where(F.col("run_id") == run_id)
    head = g.agg(
        F.count(F.lit(1)).alias("written"), F.count_if(F.col("outcome").startswith("harness_")).alias("harness_failures"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"),
        *(F.coalesce(F.percentile("total_ms", F.lit(q)), F.lit(0.0)).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)), F.coalesce(F.max("total_ms"), F.lit(0.0)).alias("max_ms"), F.coalesce(F.avg("total_ms"), F.lit(0.0)).alias("mean_ms"),
    )
    covered = F.when(F.lit(planned) > 0, F.greatest(F.lit(0), F.col("written") - F.col("harness_failures")) / F.lit(max(planned, 1))).otherwise(0.0)
    head = head.withColumns({"planned": F.lit(planned), "coverage": covered, "publishable": (F.col("written") == planned) & (covered >= floor)})
    quality = spark.read.parquet(f"{store}/aggregates").where(F.col("run_id") == run_id).drop("run_id")
    s = spark.read.parquet(f"{store}/scores").where((F.col("run_id") == run_id) & (F.col("metric") == metric)).select("case_id", "repeat_idx", "passed")
    order = F.when(F.col("outcome").startswith("harness_"), 0).when(~F.col("passed"), 1).when(F.col("passed").isNull(), 2).otherwise(3)
    examples = g.join(s, ["case_id", "repeat_idx"], "left").select(order.alias("priority"), "case_id", "repeat_idx", "outcome", "passed", t.truncate(F.col("output"), 280).alias("output")).orderBy("priority", "case_id", "repeat_idx").limit(8)
    sections = {"summary": head, "outcomes": g.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "quality": quality, "examples": examples}
    out = artifacts.report_json(run_id, sections, {"summary": ["written"], "outcomes": ["outcome"], "quality": ["metric", "slice"], "examples": ["priority", "case_id", "repeat_idx"]})
    if target:
        gates = [{"gate": "publishable", "passed": out["summary"][0]["publishable"], "measured": out["summary"][0]["coverage"]}]
        sinks.write_atomic({f"{target}/report.json": json.dumps(out, indent=2, sort_keys=True, default=str) + "\n", f"{target}/report.html": artifacts.report_html(out), f"{target}/report.xml": artifacts.report_junit(run_id, gates)})
    return out


# Calibration, judges, evidence.


def calibrate(rows: DataFrame, correct: str = "correct", confidence: str = "confidence") -> dict:
    """All calibration measures of (correct, confidence) rows."""
    frames = (calibration.adaptive_ece, calibration.brier_nll, calibration.risk_summary, calibration.roc_auc, calibration.pr_auc, calibration.best_threshold)
    out: dict = {}
    for f in frames:
        r = f(rows, correct, confidence).first()
        out |= r.asDict() if r else {}
    return out


def _object(text: F.Column, ddl: str) -> F.Column:
    return F.from_json(t.without_fence(text), ddl)


def pointwise_output(text: F.Column, low: int, high: int) -> F.Column:
    """Score of a judge's strict JSON answer, with or without a fence; null if it breaks the contract."""
    o = _object(text, "score int, reasoning string")
    return F.when(o["score"].between(low, high) & (F.btrim(o["reasoning"]) != ""), o["score"])


def pairwise_output(text: F.Column) -> F.Column:
    """A, B or tie of a judge's strict JSON answer; null if it breaks the contract."""
    o = _object(text, "preference string, reasoning string")
    return F.when(o["preference"].isin("A", "B", "tie") & (F.btrim(o["reasoning"]) != ""), o["preference"])


def nli_output(text: F.Column) -> F.Column:
    o = _object(text, "label string")
    return F.when(o["label"].isin("entailment", "neutral", "contradiction"), o["label"])


def reported_cost(raw: F.Column) -> F.Column:
    """The last cost that a raw response states, of the response, its usage or its chunks; null if none is a number of at least 0."""
    v = F.try_parse_json(raw)
    one = lambda path: F.try_variant_get(v, path, "double")
    plain = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "BOOLEAN", one(path))
    chunks = F.from_json(F.try_variant_get(v, "$.chunks", "string"), "array<struct<cost_usd:double,cost:double,usage:struct<cost_usd:double,cost:double>>>")
    per = F.flatten(F.transform(F.coalesce(chunks, F.array().cast("array<struct<cost_usd:double,cost:double,usage:struct<cost_usd:double,cost:double>>>")), lambda c: F.array(c["cost_usd"], c["cost"], c["usage"]["cost_usd"], c["usage"]["cost"])))
    stated = F.concat(F.array(*(plain(p) for p in ("$.cost_usd", "$.cost", "$.usage.cost_usd", "$.usage.cost"))), per)
    return F.try_element_at(F.filter(stated, lambda x: x >= 0), F.lit(-1))


def judge_pointwise(candidates: DataFrame, responses: DataFrame, low: int, high: int) -> DataFrame:
    """(case_id, generation_id, score): each candidate with its response's score; a candidate without response is an error."""
    r = responses.select("generation_id", pointwise_output(F.col("response"), low, high).alias("score"), F.lit(True).alias("answered"))
    joined = judging.require_total(candidates.join(r, "generation_id", "left"), "answered", "a judge's response")
    return joined.select("case_id", "generation_id", "score")


def judge_pairwise(pairs: DataFrame, responses: DataFrame) -> dict:
    """Win rates, position bias and consistency of pairs judged in both orders; no win rates if the models' graph falls apart."""
    both = pairs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("swap"))
    r = responses.select("case_id", "swap", pairwise_output(F.col("response")).alias("shown"))
    items = materialize(judging.require_total(both.join(r, ["case_id", "swap"], "left"), "shown", "a judge's preference").withColumn("preference", judging.original_preference(F.col("shown"), F.col("swap"))), "judged-pairs")
    nodes = items.select(F.explode(F.array("model_a", "model_b")).alias("node")).distinct()
    edges = items.where("preference <> 'tie'").select(F.col("model_a").alias("a"), F.col("model_b").alias("b"))
    parts = [r["size"] for r in graph.component_sizes(graph.components(nodes, edges)).orderBy(F.desc("size")).collect()]
    out = {"components": parts, "position_bias": judging.position_bias(items).first()[1], "consistency": judging.swap_consistency(items, "case_id").first()[1]}
    return out | {"win_rates": {r.model: r.win_rate for r in judging.win_rates(items).collect()} if len(parts) == 1 else None}


def judge_validate(judgments: DataFrame, labels: DataFrame, judge_family: str, candidate_family: str, measure: str = "cohen_kappa", least: float = 0.6, min_holdout: int = 20, min_dev: int = 20) -> dict:
    """Agreement of a judge with holdout labels, and whether it may gate; reasons if not. Labels: case_id, label_value, split."""
    rated = judging.one_to_one(labels.where("split = 'holdout'").select("case_id", F.col("label_value").cast("string").alias("human")), judgments.select("case_id", F.col("score").cast("string").alias("judge")), "case_id")
    table = calibration.rating_table(rated, "human", "judge")
    if measure != "cohen_kappa":
        table = table.withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})
    value = {"cohen_kappa": calibration.cohen_kappa, "spearman": calibration.spearman, "krippendorff": lambda x: calibration.krippendorff(x, True)}[measure](table).first()
    n = labels.agg(F.count_if(F.col("split") == "dev").alias("n_dev")).crossJoin(rated.agg(F.count(F.lit(1)).alias("n_holdout")))
    stats = n.withColumns({"judge_family": F.lit(judge_family), "candidate_family": F.lit(candidate_family), "agreement": F.lit(value[0] if value else None).cast("double")})
    out = judging.calibration_gate(stats, "agreement", least, min_holdout, min_dev).first().asDict()
    return out | {"calibration_digest": artifacts.identity(out, ["calibration_digest"])}


def attach_calibration(judgment: Mapping, certificate: Mapping) -> dict:
    """The judgment with its calibration; a certificate that was changed or refuses is an error."""
    if artifacts.identity(certificate, ["calibration_digest"]) != certificate["calibration_digest"]:
        raise ValueError("the calibration's digest doesn't match its content")
    if not certificate["gating_allowed"]:
        raise ValueError("the calibration doesn't allow gating: " + "; ".join(certificate["reasons"]))
    return dict(judgment) | {"calibration_digest": certificate["calibration_digest"], "gating_allowed": True}


def rag_evidence(cases: DataFrame, nli: DataFrame) -> dict:
    """Context precision and recall, share of unsupported claims and attribution of citations.

    cases: schemas.EVIDENCE; nli: case_id, claim_index, doc_id, label, of which the last row of a key counts.
    """
    ctx = rag.context_scores(cases.withColumn("relevant", F.when(F.col("qrels").isNotNull(), F.map_keys(m.relevant(F.col("qrels"))))), "context_ids", "relevant").agg(F.avg("context_precision").alias("context_precision"), F.avg("context_recall").alias("context_recall"))
    labels = rag.last_label(nli.withColumn("_n", F.monotonically_increasing_id()), ["case_id", "claim_index", "doc_id"], "_n")
    told = F.when(F.size("claims") > 0, F.transform(F.slice("claims", 1, 20), lambda c: t.truncate(c, 280))).otherwise(t.claims(F.col("answer_text")))
    grid = cases.select("case_id", F.slice("context_ids", 1, rag.CONTEXTS).alias("docs"), F.posexplode(told).alias("claim_index", "claim")).select("case_id", "claim_index", F.explode_outer("docs").alias("doc_id"))
    claims = rag.unsupported_rate(grid.join(labels, ["case_id", "claim_index", "doc_id"], "left"), ["case_id", "claim_index"])
    cited = cases.select("case_id", "context_ids", "qrels", F.explode("citations").alias("doc_id"))
    entails = labels.where("label = 'entailment'").select("case_id", "doc_id", F.lit(True).alias("entailed")).distinct()
    judged = cited.join(entails, ["case_id", "doc_id"], "left").select(F.array_contains("context_ids", F.col("doc_id")).alias("present"), (F.try_element_at(m.relevant(F.col("qrels")), F.col("doc_id")) > 0).alias("relevant"), "entailed")
    return {**ctx.first().asDict(), **claims.first().asDict(), **rag.citation_attribution(judged).first().asDict()}


# Manifests and suites.


def _unique(kind: str, rows: Sequence[Mapping]) -> set[str]:
    ids = [r["id"] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError(f"{kind} ids must be unique")
    return set(ids)


def matrix_validate(matrix: Mapping) -> str:
    """Digest of a matrix of models, prompts and datasets whose cells name only what is declared; `latest` is no version."""
    for kind in ("models", "prompts", "datasets", "cells"):
        if not matrix.get(kind):
            raise ValueError(f"{kind} must not be empty")
    known = {kind: _unique(kind, matrix[f"{kind}s"]) for kind in ("model", "prompt", "dataset")}
    _unique("cell", matrix["cells"])
    for x in matrix["models"]:
        if "latest" in (str(x.get("model")).casefold(), str(x.get("revision")).casefold()):
            raise ValueError("a model must be pinned, not latest")
    for cell in matrix["cells"]:
        for kind, ids in known.items():
            if cell[kind] not in ids:
                raise ValueError(f"cell {cell['id']} names an unknown {kind} {cell[kind]}")
    if int(matrix.get("repeats", 0)) < 1:
        raise ValueError("repeats must be at least 1")
    return artifacts.digest(matrix)


def baseline_promote(matrix: Mapping, baseline: Mapping | None, cell_id: str, run_report: Mapping) -> dict:
    """The baseline with one cell pinned to a run; cells stay in order of id."""
    if cell_id not in _unique("cell", matrix["cells"]):
        raise ValueError(f"unknown cell {cell_id}")
    cells = {c["cell_id"]: c for c in (baseline or {}).get("cells", [])} | {cell_id: {"cell_id": cell_id, "run_id": str(uuid.UUID(run_report["name"])), "run_report_digest": run_report["digest"]}}
    return {"schema_version": "0.1", "matrix_digest": artifacts.digest(matrix), "cells": [cells[k] for k in sorted(cells)]}


def baseline_validate(baseline: Mapping, matrix: Mapping, reports: Mapping[str, Mapping]) -> list[str]:
    """What is wrong with a baseline: another matrix, unknown cells, reports missing or changed."""
    out = [] if baseline["matrix_digest"] == artifacts.digest(matrix) else ["the baseline belongs to another matrix"]
    known = {c["id"] for c in matrix["cells"]}
    for c in baseline["cells"]:
        if c["cell_id"] not in known:
            out.append(f"unknown cell {c['cell_id']}")
        r = reports.get(c["run_id"])
        if r is None or artifacts.identity(r, ["digest"]) != c["run_report_digest"]:
            out.append(f"the report of {c['cell_id']} is missing or changed")
    return out


def suite_build(spark: SparkSession, reports: Sequence[Mapping], metrics: Mapping[str, str], target: str | None = None) -> dict:
    """A suite of run reports: members, leaderboards by metric, slices from the weakest, failures; only publishable runs are ranked.

    metrics: run -> the metric it is measured by. The reports' few rows are joined as frames.
    """
    missing = [r["name"] for r in reports if r["name"] not in metrics]
    if missing:
        raise ValueError(f"no metric is declared for {missing}")
    rows = [(r["name"], q["metric"], q["slice"], q["n"], float(q["value"]), bool(r["summary"][0]["publishable"])) for r in reports for q in r["quality"] if q["metric"] == metrics[r["name"]]]
    q = spark.createDataFrame(rows, "run string, metric string, slice string, n long, value double, publishable boolean")
    shots = spark.createDataFrame([(i, r["name"], e["case_id"], e["repeat_idx"], e["outcome"], e["output"]) for i, r in enumerate(reports) for e in r["examples"] if e["passed"] is False or str(e["outcome"]).startswith("harness_")], "member int, run string, case_id string, repeat_idx int, outcome string, output string")
    overall = q.where(F.col("slice") == rollup.OVERALL)
    sections = {
        "members": spark.createDataFrame([(r["name"], r["digest"], bool(r["summary"][0]["publishable"])) for r in reports], "run string, digest string, publishable boolean"),
        "leaderboard": overall.where("publishable").select("metric", (-F.col("value")).alias("order"), "run", "n", "value"),
        "excluded": overall.where("not publishable").select("run", F.lit("not publishable").alias("reason")),
        "slices": q.where(F.col("slice") != rollup.OVERALL).select("run", "value", "slice", "n"),
        "failures": shots.orderBy("member", "case_id", "repeat_idx").limit(24),
    }
    out = artifacts.report_json("suite", sections, {"members": ["run"], "leaderboard": ["metric", "order", "run"], "excluded": ["run"], "slices": ["run", "value", "slice"], "failures": ["member", "case_id", "repeat_idx"]})
    out["suite_digest"] = artifacts.suite_digest(out["members"], metrics)
    if target:
        sinks.write_atomic({f"{target}/suite.json": json.dumps(out, indent=2, sort_keys=True) + "\n", f"{target}/suite.html": artifacts.report_html(out)})
    return out


def suite_validate(suite: Mapping) -> bool:
    """Whether a suite's content is what its digest says."""
    return artifacts.identity({k: v for k, v in suite.items() if k != "suite_digest"}, ["digest"]) == suite["digest"]


def gates_check(rows: DataFrame, bounds: Mapping[str, tuple[str, str, float, bool]], key: str) -> tuple[DataFrame, DataFrame]:
    """(each gate's result, the verdict of each key)."""
    results = artifacts.evaluate_gates(rows, bounds, key)
    return results, artifacts.roll_up(results, key)


def gates_from_file(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None) -> dict:
    """The evaluation of a policy file: each gate with its reason, and whether a blocking or an informational one fails."""
    name, policy, found = gates.load(path, overrides)
    needed = ", ".join(gates.COLUMNS[k] for k in gates.COLUMNS if k in found)
    row = gates.report_row(found)
    schema = spark.createDataFrame([], f"key string, {needed}").schema
    values = [float(v) if isinstance(v, int) and not isinstance(v, bool) and f.dataType.typeName() == "double" else {k: float(x) for k, x in v.items()} if isinstance(v, dict) else v for f in schema.fields[1:] for v in [row[f.name]]]
    results = [r.asDict() for r in gates.evaluate(spark.createDataFrame([(name, *values)], schema), policy, "key").drop("key").collect()]  # a row a gate
    soft = any(not r["passed"] and r["severity"] == "informational" for r in results)
    return {"schema_version": gates.SCHEMA_VERSION, "gates_name": name, "results": results, "blocking_failed": any(r["blocking_failure"] for r in results), "informational_failed": soft}


def judge_inputs(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """candidates, pairs, labels, responses, evidence or nli from JSON Lines of the declared schema."""
    schema = {"candidates": schemas.CANDIDATE, "pairs": schemas.PAIR, "labels": schemas.LABEL, "responses": schemas.MOCK_RESPONSE, "evidence": schemas.EVIDENCE, "nli": schemas.NLI}[kind]
    return datasets.read_jsonl(spark, path, schema)
