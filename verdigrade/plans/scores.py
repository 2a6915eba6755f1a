"""Roll-ups, report aggregates and run comparison over the evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions.stats import Z95, pass_at_k, wilson
from verdigrade.operators import compare as cmp
from verdigrade.operators.ordered import top_rows
from verdigrade.operators.rollup import by_slice, kept_dimensions, score_rollup
from verdigrade.plans import views as v
from verdigrade.plans.views import BASELINE, CANDIDATE, CASES_SQL, GEN_SQL, JUDGE_SQL, RESP_SQL
from verdigrade.session import table

FAILED = ("harness_error", "harness_timeout")
_Z = repr(Z95)


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    p, z = f"(({s})::DOUBLE/nullif({n},0))", f"{_Z}::DOUBLE"
    mid = f"(({p} + {z}*{z}/(2*{n}))/(1+{z}*{z}/{n}))"
    half = f"({z}*sqrt(({p}*(1-{p}) + {z}*{z}/(4*{n}))/{n})/(1+{z}*{z}/{n}))"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, {mid}-{half}) END", f"CASE WHEN {n} <= 0 THEN 0.0 ELSE least(1.0, {mid}+{half}) END"


def pass_rate_overall(spark: SparkSession, d: str) -> DataFrame:
    a = v.gen(spark, d).where("passed is not null").groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))
    lo, hi = wilson(F.col("n_passed"), F.col("n"))
    return a.select("*", (F.col("n_passed") / F.col("n")).alias("pass_rate"), lo.alias("ci_low"), hi.alias("ci_high"))


def _sliced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Generations with the slices of their case, and the dimensions that are kept."""
    c = v.cases(spark, d).select("case_id", "slices")
    g = v.gen(spark, d).drop("slices").join(c, "case_id")
    return g, kept_dimensions(c)


def pass_rate_by_slice(spark: SparkSession, d: str) -> DataFrame:
    g, dims = _sliced(spark, d)
    sums = (F.count("passed").alias("n"), F.count_if(F.col("passed")).alias("n_passed"))
    s = by_slice(g.where("passed is not null"), "slices", dims, sums, ["metric"])
    lo, hi = wilson(F.col("n_passed"), F.col("n"))
    return s.select("metric", "slice", "n", "n_passed", lo.alias("ci_low"), hi.alias("ci_high"))


def slice_rollup_wilson(spark: SparkSession, d: str) -> DataFrame:
    g, dims = _sliced(spark, d)
    return score_rollup(g.select("run_id", "metric", "slices", F.col("metric_value").alias("value"), F.lit(0.5).alias("threshold")), ["run_id", "metric"], dims, rates=("exact_match",))


def slice_cardinality_guard(spark: SparkSession, d: str) -> DataFrame:
    c = v.cases(spark, d)
    wide = c.select(F.map_concat(F.coalesce("slices", F.create_map().cast("map<string,string>")), F.create_map(F.lit("own"), F.col("case_id"))).alias("slices"))
    return kept_dimensions(wide)


def coverage_publishable(spark: SparkSession, d: str) -> DataFrame:
    planned = v.cases(spark, d).agg((F.count(F.lit(1)) * 5).alias("planned"))
    g = v.gen(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("outcome").isin(*FAILED)).alias("harness_failures"))
    cover = F.coalesce(F.try_divide(F.greatest(F.lit(0), F.col("written") - F.col("harness_failures")).cast("double"), F.col("planned")), F.lit(0.0))
    return g.crossJoin(F.broadcast(planned)).select("*", cover.alias("coverage"), ((F.col("written") == F.col("planned")) & (cover >= 0.98)).alias("publishable"))


def planned_vs_written(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.plan import remaining

    left = remaining(v.cases(spark, d).select("case_id"), 5, v.gen(spark, d).where(F.col("run_id") == BASELINE))
    return left.groupBy("repeat_idx").agg(F.count(F.lit(1)).alias("n_missing"))


def resume_plan_antijoin(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.plan import remaining

    return remaining(v.cases(spark, d).select("case_id"), 5, v.gen(spark, d).where(F.col("run_id") == BASELINE))


def outcome_histogram_pct(spark: SparkSession, d: str) -> DataFrame:
    h = v.gen(spark, d).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    t = h.groupBy("run_id").agg(F.sum("n").alias("all"))
    return h.join(F.broadcast(t), "run_id").select("run_id", "outcome", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"))


def finish_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("outcome") == "truncated", "length").when(F.col("outcome") == "content_filtered", "content_filter").when(~F.col("outcome").isin(*FAILED), "stop")
    return v.gen(spark, d).groupBy(F.coalesce(reason, F.lit("unknown")).alias("finish_reason")).agg(F.count(F.lit(1)).alias("n"))


def _latency(keys: list[str], g: DataFrame) -> DataFrame:
    q = lambda p: F.coalesce(F.percentile("latency_ms", F.lit(p)), F.lit(0.0))
    return g.where("latency_ms is not null and not isnan(latency_ms)").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(q(p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)), F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").alias("mean_ms")
    )


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _latency([], v.gen(spark, d))


def latency_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _latency(["run_id"], v.gen(spark, d))


def retries_cache_rate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", F.expr("1 + l_linenumber % 3").alias("attempts"), (F.col("l_linestatus") == "F").alias("cached"))
    return li.groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).cast("bigint").alias("retries"), F.count_if("cached").alias("cache_hits"), F.avg(F.col("cached").cast("double")).alias("cache_rate")
    )


def known_and_unknown_sums(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("decimal(12,2)")).alias("cost"))
    return li.groupBy("run_id").agg(F.sum("cost").cast("double").alias("total"), F.count_if(F.col("cost").isNull()).alias("n_unknown"))


def headline_quality(spark: SparkSession, d: str) -> DataFrame:
    a = v.gen(spark, d).groupBy("run_id", "metric").agg(F.count("passed").alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("n_passed"), F.avg("metric_value").alias("mean"))
    lo, hi = wilson(F.col("n_passed"), F.col("n"))
    gated = F.col("metric") == "exact_match"
    return a.select("run_id", "metric", F.when(gated, F.col("n_passed") / F.col("n")).otherwise(F.col("mean")).alias("value"), F.when(gated, lo).alias("ci_low"), F.when(gated, hi).alias("ci_high"))


def _priority() -> F.Column:
    return F.when(F.col("outcome").isin(*FAILED), 0).when(~F.col("passed"), 1).when(F.col("passed").isNull(), 2).otherwise(3)


def case_examples_topk(spark: SparkSession, d: str) -> DataFrame:
    g = v.gen(spark, d).where(F.col("run_id") == BASELINE).select(_priority().alias("priority"), "case_id", "repeat_idx", "example_id", "outcome")
    return top_rows(g, 8, F.col("priority"), F.col("case_id"), F.col("repeat_idx"), F.col("example_id"))


def trace_ids_first10(spark: SparkSession, d: str) -> DataFrame:
    g = v.gen(spark, d).where("trace_id is not null").groupBy("trace_id").agg(F.min("example_id").alias("first_id"))
    return top_rows(g, 10, F.col("first_id"), F.col("trace_id"))


def per_metric_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return v.gen(spark, d).groupBy("metric").agg(F.count("metric_value").alias("n"), F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("stddev"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the two runs by case and repeat; of several generations with one key the first id counts."""
    g = v.gen(spark, d).where(F.col("run_id").isin(BASELINE, CANDIDATE) & F.col("case_id").isNotNull())
    one = g.groupBy("run_id", "case_id", "repeat_idx").agg(F.min_by("passed", "example_id").alias("passed"))
    return cmp.paired(one.where(F.col("run_id") == BASELINE), one.where(F.col("run_id") == CANDIDATE), ["case_id", "repeat_idx"])


def flaky_cases(spark: SparkSession, d: str) -> DataFrame:
    return cmp.flaky(_pairs(spark, d), "case_id")


def run_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where(~F.col("old").eqNullSafe(F.col("new")))


def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return cmp.compare_binary(p.join(cmp.flaky(p, "case_id"), "case_id", "left_anti"))


def paired_compare_counts(spark: SparkSession, d: str) -> DataFrame:
    return cmp.compare_binary(_pairs(spark, d)).select("n", "only_baseline", "only_candidate", "baseline_rate", "candidate_rate", "delta")


def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    return cmp.compare_binary(_pairs(spark, d)).select("only_baseline", "only_candidate", "p_value")


def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cmp.compare_binary(_pairs(spark, d)).select("delta", "relative_delta", "cohens_h")


def delta_interval(spark: SparkSession, d: str) -> DataFrame:
    return cmp.delta_interval(_pairs(spark, d))


def metric_interval(spark: SparkSession, d: str) -> DataFrame:
    return cmp.interval(v.gen(spark, d), "metric_value")


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    """A p for each nation: how far its count of orders lies from the mean, through a fixed squashing."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    m = c.agg(F.avg("n").alias("m"))
    return c.crossJoin(F.broadcast(m)).select("c_nationkey", F.round(F.exp(-F.abs(F.col("n") - F.col("m")) / 2.0), 9).alias("p_value"))


def benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return cmp.benjamini_hochberg(_p_values(spark, d), q=0.2)


def between_repeat_variance(spark: SparkSession, d: str) -> DataFrame:
    return cmp.between_repeat_variance(v.gen(spark, d).where("metric_value is not null and case_id is not null"), "case_id", "metric_value")


def pass_at_3(spark: SparkSession, d: str) -> DataFrame:
    g = v.gen(spark, d).where("passed is not null and case_id is not null").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    return g.where("n >= 3").groupBy("n", "c").agg(F.count(F.lit(1)).alias("n_cases"), F.first(pass_at_k(F.col("n"), F.col("c"), 3)).alias("pass_at_3"))


def slices_weakest_first(spark: SparkSession, d: str) -> DataFrame:
    r = slice_rollup_wilson(spark, d).where("slice <> '__overall__'")
    return top_rows(r.select("run_id", "metric", "slice", F.round("value", 9).alias("value")), 20, F.col("value"), F.col("run_id"), F.col("metric"), F.col("slice"))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = v.gen(spark, d).where("metric_value is not null").groupBy("task_type", "metric", "run_id").agg(F.round(F.avg("metric_value"), 9).alias("value"))
    w = Window.partitionBy("task_type", "metric").orderBy(F.col("value").desc(), "run_id")
    return g.withColumn("place", F.row_number().over(w))


def quality_tables(spark: SparkSession, d: str) -> DataFrame:
    c = v.cases(spark, d).select("case_id", F.col("slices")["domain"].alias("domain"), F.col("task_type").alias("task"))
    g = v.gen(spark, d).select("case_id", "metric", "metric_value").join(c, "case_id")
    one = lambda kind, col: g.groupBy("metric", F.col(col).alias("name")).agg(F.count("metric_value").alias("n"), F.avg("metric_value").alias("value")).withColumn("kind", F.lit(kind))
    return one("domain", "domain").unionByName(one("task", "task"))


def failure_gallery(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = v.gen(spark, d).where((F.col("passed") == F.lit(False)) | F.col("outcome").startswith("harness_")).select("run_id", "case_id", "repeat_idx", "example_id", "outcome")
    w = Window.partitionBy("run_id").orderBy("case_id", "repeat_idx", "example_id")
    first = f.withColumn("place", F.row_number().over(w)).where("place <= 8")  # Spark keeps a heap a run
    return top_rows(first, 24, F.col("run_id"), F.col("place"))


def gate_evaluation(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.artifacts import evaluate_gates

    run = coverage_publishable(spark, d).join(latency_by_run(spark, d).select("run_id", "p95"), "run_id")
    quality = v.gen(spark, d).where("metric = 'exact_match'").groupBy("run_id").agg(F.avg("metric_value").alias("quality"))
    return evaluate_gates(run.join(quality, "run_id", "left"), {"coverage": ("coverage", ">=", 0.98, True), "latency": ("p95", "<=", 5000.0, True), "quality": ("quality", ">=", 0.5, False)}, "run_id")


RELEASE = {
    "schema_version": "0.1", "name": "release", "artifacts": {"run_report": "run.json", "calibration": "calibration.json"},
    "gates": [
        {"name": "covered", "kind": "coverage", "severity": "blocking", "require_completed": False, "min_coverage": 0.2},
        {"name": "harness", "kind": "harness_failure_rate", "severity": "blocking", "max_rate": 0.002},
        {"name": "quality", "kind": "quality_floor", "severity": "blocking", "metric": "exact_match", "min_value": 0.55},
        {"name": "fast", "kind": "latency", "severity": "informational", "max_p95_ms": 9000},
        {"name": "cheap", "kind": "cost", "severity": "informational", "max_usd": 2000},
        {"name": "judge", "kind": "calibrated_judge", "severity": "blocking", "min_agreement": 0.2},
    ],
}


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    """A policy held against every run: priced by its tokens' time, with the share of generations that two raters score alike as the judge's agreement."""
    from verdigrade.operators import gates

    priced = F.coalesce(F.col("latency_ms") >= 0, F.lit(False)) & ~F.isnan("latency_ms")
    g = v.gen(spark, d).groupBy("run_id").agg(
        F.count_if(F.col("outcome").isin(*FAILED)).alias("harness_failures"), F.count(F.lit(1)).alias("planned_generations"), F.round(F.avg(F.when(F.col("metric") == "exact_match", F.col("metric_value"))), 9).alias("exact"),
        F.coalesce(F.round(F.sum(F.when(priced, F.col("latency_ms"))) / 1000, 6), F.lit(0.0)).alias("cost_usd_total"), F.count_if(~F.coalesce(priced, F.lit(False))).alias("cost_unpriced_generations"),
    )
    rows = coverage_publishable(spark, d).select("run_id", "coverage").join(latency_by_run(spark, d).select("run_id", F.col("p95").alias("p95_ms")), "run_id").join(g, "run_id")
    first = lambda df, key, name: df.where(F.col("score").isNotNull() & F.col("generation_id").isNotNull()).groupBy("generation_id").agg(F.min_by("score", key).alias(name))
    agreed = first(v.judged(spark, d), "judgment_id", "a").join(first(v.resp(spark, d), "response_id", "b"), "generation_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("holdout_agreement"))
    rows = rows.crossJoin(F.broadcast(agreed)).withColumns({"run_status": F.lit("completed"), "coverage_floor": F.lit(0.98), "quality": F.create_map(F.lit("exact_match"), F.col("exact")), "gating_allowed": F.lit(True)})  # one row
    _, policy, _ = gates.parse(RELEASE)
    return gates.evaluate(rows, policy, "run_id").drop("reason")


def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.plan import seeded_sample

    return seeded_sample(v.cases(spark, d).select("case_id", "task_type"), "case_id", 7, 50)


def first_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.sinks import first_wins

    g = table(spark, d, "qa_baseline").select("example_id", "outcome", "loaded_at")
    old = g.where("loaded_at < timestamp '2025-09-15 00:00:00'").groupBy("example_id").agg(F.min_by("outcome", "loaded_at").alias("outcome"))
    new = g.where("loaded_at >= timestamp '2025-09-15 00:00:00'").groupBy("example_id").agg(F.min_by("outcome", "loaded_at").alias("outcome"))
    return first_wins(old, new, ["example_id"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.operators.sinks import last_wins

    g = table(spark, d, "eval_cases").select("case_id", "deleted_at", "loaded_at", "task_type")
    old, new = (g.where(f"loaded_at {op} timestamp '2025-04-01 00:00:00'").groupBy("case_id").agg(F.max_by(F.struct("task_type", "deleted_at"), "loaded_at").alias("r")).select("case_id", "r.*") for op in ("<", ">="))
    return last_wins(old, new, ["case_id"]).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("n_deleted"))


_G = f"WITH {GEN_SQL} "
_GC = f"WITH {GEN_SQL}, {CASES_SQL}"
_FAN = """, dims AS (SELECT e.key AS dimension FROM (SELECT unnest(map_entries(slices)) AS e FROM cases) GROUP BY 1 HAVING count(DISTINCT e.value) <= 50),
j AS (SELECT g.*, c.slices AS s FROM gen g JOIN cases c USING (case_id)),
f AS (SELECT *, '__overall__' AS slice FROM j UNION ALL SELECT j.*, e.key || '=' || coalesce(e.value, '') FROM j, unnest(map_entries(j.s)) t(e) WHERE e.key IN (SELECT dimension FROM dims))"""
_LOW, _HIGH = wilson_sql("n_passed", "n")
_PAIRS = f"""{_G}, one AS (SELECT run_id, case_id, repeat_idx, arg_min_null(passed, example_id) AS passed FROM gen WHERE run_id IN ('{BASELINE}', '{CANDIDATE}') AND case_id IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT a.case_id, a.repeat_idx, a.passed AS old, b.passed AS new FROM one a JOIN one b USING (case_id, repeat_idx) WHERE a.run_id = '{BASELINE}' AND b.run_id = '{CANDIDATE}' AND a.passed IS NOT NULL AND b.passed IS NOT NULL)"""
_CMP = "c AS (SELECT count(*) AS n, avg(old::INT) AS a, avg(new::INT) AS b, count(*) FILTER (old AND NOT new) AS x, count(*) FILTER (NOT old AND new) AS y FROM {})"
_P = "CASE WHEN x = y THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(x+y+1) - lgamma(i+1) - lgamma(x+y-i+1) - (x+y)*ln(2))) FROM range(0, least(x,y)+1) t(i))) END"
_LAT = "count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.9) AS p90, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, max(latency_ms) AS max_ms, avg(latency_ms) AS mean_ms FROM gen WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)"
_COVER = """cov AS (SELECT run_id, count(*) AS written, count(*) FILTER (outcome IN ('harness_error', 'harness_timeout')) AS harness_failures, (SELECT count(*) * 5 FROM cases) AS planned FROM gen GROUP BY 1),
cover AS (SELECT run_id, written, harness_failures, planned, greatest(0, written - harness_failures) / planned::DOUBLE AS coverage, written = planned AND greatest(0, written - harness_failures) / planned::DOUBLE >= 0.98 AS publishable FROM cov)"""
_ROLL = f"""{_GC}{_FAN}, s AS (SELECT run_id, metric, slice, count(metric_value) AS n, count(*) FILTER (metric_value >= 0.5) AS n_passed, coalesce(avg(metric_value), 0) AS value, stddev_pop(metric_value) AS stddev FROM f GROUP BY 1, 2, 3)"""
_LEFT = f"{_GC} SELECT case_id, r::INT AS repeat_idx FROM cases, range(0, 5) t(r) WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.run_id = '{BASELINE}' AND g.case_id = cases.case_id AND g.repeat_idx = r)"

ORACLE = {
    "pass_rate_overall": f"{_G}, s AS (SELECT run_id, metric, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM gen WHERE passed IS NOT NULL GROUP BY 1, 2) SELECT *, n_passed / n::DOUBLE AS pass_rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM s",
    "pass_rate_by_slice": f"{_GC}{_FAN}, s AS (SELECT metric, slice, count(passed) AS n, count(*) FILTER (passed) AS n_passed FROM f WHERE passed IS NOT NULL GROUP BY 1, 2) SELECT *, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM s",
    "slice_rollup_wilson": f"{_ROLL} SELECT run_id, metric, slice, n, value, CASE WHEN metric <> 'exact_match' OR n > 0 THEN {_LOW} END AS ci_low, CASE WHEN metric <> 'exact_match' OR n > 0 THEN {_HIGH} END AS ci_high, CASE WHEN metric <> 'exact_match' THEN stddev END AS stddev FROM s",
    "slice_cardinality_guard": f"WITH {CASES_SQL} SELECT e.key AS dimension, count(DISTINCT e.value) AS n_values FROM (SELECT unnest(map_entries(slices)) AS e FROM cases UNION ALL SELECT {{'key': 'own', 'value': case_id}} FROM cases) GROUP BY 1 HAVING count(DISTINCT e.value) <= 50",
    "coverage_publishable": f"{_GC}, {_COVER} SELECT * FROM cover",
    "planned_vs_written": f"SELECT repeat_idx, count(*) AS n_missing FROM ({_LEFT}) GROUP BY 1",
    "resume_plan_antijoin": _LEFT,
    "outcome_histogram_pct": f"{_G} SELECT run_id, outcome, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS pct FROM gen GROUP BY 1, 2",
    "finish_reason_histogram": f"{_G} SELECT CASE outcome WHEN 'truncated' THEN 'length' WHEN 'content_filtered' THEN 'content_filter' WHEN 'harness_error' THEN 'unknown' WHEN 'harness_timeout' THEN 'unknown' ELSE 'stop' END AS finish_reason, count(*) AS n FROM gen GROUP BY 1",
    "latency_percentiles": f"{_G} SELECT {_LAT}",
    "latency_by_run": f"{_G} SELECT run_id, {_LAT} GROUP BY 1",
    "retries_cache_rate": "SELECT l_returnflag AS run_id, sum(l_linenumber % 3)::BIGINT AS retries, count(*) FILTER (l_linestatus = 'F') AS cache_hits, avg((l_linestatus = 'F')::INT) AS cache_rate FROM lineitem GROUP BY 1",
    "known_and_unknown_sums": "SELECT l_returnflag AS run_id, sum(CASE WHEN l_linenumber <> 7 THEN l_quantity::DECIMAL(12,2) END)::DOUBLE AS total, count(*) FILTER (l_linenumber = 7) AS n_unknown FROM lineitem GROUP BY 1",
    "headline_quality": f"{_G}, s AS (SELECT run_id, metric, count(passed) AS n, count(*) FILTER (passed) AS n_passed, avg(metric_value) AS mean FROM gen GROUP BY 1, 2) SELECT run_id, metric, CASE WHEN metric = 'exact_match' THEN n_passed / n::DOUBLE ELSE mean END AS value, CASE WHEN metric = 'exact_match' THEN {_LOW} END AS ci_low, CASE WHEN metric = 'exact_match' THEN {_HIGH} END AS ci_high FROM s",
    "case_examples_topk": f"{_G} SELECT CASE WHEN outcome IN ('harness_error', 'harness_timeout') THEN 0 WHEN NOT passed THEN 1 WHEN passed IS NULL THEN 2 ELSE 3 END AS priority, case_id, repeat_idx, example_id, outcome FROM gen WHERE run_id = '{BASELINE}' ORDER BY 1, case_id NULLS FIRST, 3, 4 LIMIT 8",
    "trace_ids_first10": f"{_G} SELECT trace_id, min(example_id) AS first_id FROM gen WHERE trace_id IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
    "per_metric_aggregates": f"{_G} SELECT metric, count(metric_value) AS n, avg(metric_value) AS mean, stddev_pop(metric_value) AS stddev FROM gen GROUP BY 1",
    "flaky_cases": f"{_PAIRS} SELECT case_id FROM p GROUP BY 1 HAVING count(DISTINCT old) > 1 OR count(DISTINCT new) > 1",
    "run_disagreements": f"{_PAIRS} SELECT case_id, repeat_idx, old, new FROM p WHERE old IS DISTINCT FROM new",
    "paired_compare": f"{_PAIRS}, k AS (SELECT * FROM p WHERE case_id NOT IN (SELECT case_id FROM p GROUP BY 1 HAVING count(DISTINCT old) > 1 OR count(DISTINCT new) > 1)), {_CMP.format('k')} SELECT n, a AS baseline_rate, b AS candidate_rate, x AS only_baseline, y AS only_candidate, b - a AS delta, (b - a) / nullif(a, 0) AS relative_delta, {_P} AS p_value, 2 * (asin(sqrt(b)) - asin(sqrt(a))) AS cohens_h FROM c",
    "paired_compare_counts": f"{_PAIRS}, {_CMP.format('p')} SELECT n, x AS only_baseline, y AS only_candidate, a AS baseline_rate, b AS candidate_rate, b - a AS delta FROM c",
    "mcnemar_exact": f"{_PAIRS}, {_CMP.format('p')} SELECT x AS only_baseline, y AS only_candidate, {_P} AS p_value FROM c",
    "effect_sizes": f"{_PAIRS}, {_CMP.format('p')} SELECT b - a AS delta, (b - a) / nullif(a, 0) AS relative_delta, 2 * (asin(sqrt(b)) - asin(sqrt(a))) AS cohens_h FROM c",
    "benjamini_hochberg": "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT c_nationkey, round(exp(-abs(n - (SELECT avg(n) FROM c)) / 2.0), 9) AS p_value FROM c), r AS (SELECT *, row_number() OVER (ORDER BY p_value, c_nationkey) AS r, count(*) OVER () AS m FROM t) SELECT c_nationkey, p_value, coalesce(p_value <= (SELECT max(p_value) FROM r WHERE p_value <= 0.2 * r / m), false) AS rejected FROM t",
    "between_repeat_variance": f"{_G} SELECT coalesce(avg(s), 0) AS variance FROM (SELECT var_samp(metric_value) AS s FROM gen WHERE metric_value IS NOT NULL AND case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1)",
    "pass_at_3": f"{_G}, s AS (SELECT case_id, count(*) AS n, count(*) FILTER (passed) AS c FROM gen WHERE passed IS NOT NULL AND case_id IS NOT NULL GROUP BY 1) SELECT n, c, count(*) AS n_cases, CASE WHEN n - c < 3 THEN 1.0 ELSE 1 - (n-c)/n::DOUBLE * (n-c-1)/(n-1) * (n-c-2)/(n-2) END AS pass_at_3 FROM s WHERE n >= 3 GROUP BY 1, 2",
    "slices_weakest_first": f"{_ROLL} SELECT run_id, metric, slice, round(value, 9) AS value FROM s WHERE slice <> '__overall__' ORDER BY 4, 1, 2, 3 LIMIT 20",
    "leaderboard": f"{_G}, s AS (SELECT task_type, metric, run_id, round(avg(metric_value), 9) AS value FROM gen WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY task_type, metric ORDER BY value DESC, run_id)::INT AS place FROM s",
    "quality_tables": f"{_GC}, j AS (SELECT g.metric, g.metric_value, element_at(c.slices, 'domain')[1] AS domain, c.task_type AS task FROM gen g JOIN cases c USING (case_id)) SELECT metric, domain AS name, count(metric_value) AS n, avg(metric_value) AS value, 'domain' AS kind FROM j GROUP BY 1, 2 UNION ALL SELECT metric, task, count(metric_value), avg(metric_value), 'task' FROM j GROUP BY 1, 2",
    "failure_gallery": f"{_G}, r AS (SELECT run_id, case_id, repeat_idx, example_id, outcome, row_number() OVER (PARTITION BY run_id ORDER BY case_id NULLS FIRST, repeat_idx, example_id)::INT AS place FROM gen WHERE passed = false OR outcome LIKE 'harness\\_%' ESCAPE '\\') SELECT * FROM r WHERE place <= 8 ORDER BY run_id, place LIMIT 24",
    "gate_evaluation": f"{_GC}, {_COVER}, r AS (SELECT c.run_id, c.coverage, l.p95, q.quality FROM cover c JOIN (SELECT run_id, {_LAT} GROUP BY 1) l USING (run_id) LEFT JOIN (SELECT run_id, avg(metric_value) AS quality FROM gen WHERE metric = 'exact_match' GROUP BY 1) q USING (run_id))\n"
    "SELECT run_id, 'coverage' AS gate, coverage AS measured, coalesce(coverage >= 0.98, false) AS passed, true AS blocking FROM r UNION ALL SELECT run_id, 'latency', p95, coalesce(p95 <= 5000, false), true FROM r UNION ALL SELECT run_id, 'quality', quality, coalesce(quality >= 0.5, false), false FROM r",
    "release_gates": f"""{_GC}, {_COVER}, g AS (SELECT run_id, count(*) FILTER (outcome IN ('harness_error', 'harness_timeout')) / count(*)::DOUBLE AS failing, round(avg(metric_value) FILTER (metric = 'exact_match'), 9) AS exact,
 round(coalesce(sum(latency_ms) FILTER (latency_ms >= 0 AND NOT isnan(latency_ms)), 0) / 1000, 6) AS usd, count(*) FILTER (latency_ms IS NULL OR isnan(latency_ms) OR latency_ms < 0) AS unpriced FROM gen GROUP BY 1),
 {JUDGE_SQL}, {RESP_SQL}, agreed AS (SELECT avg((x.a = y.b)::INT) AS share FROM (SELECT generation_id, arg_min(score, judgment_id) AS a FROM judged WHERE generation_id IS NOT NULL AND score IS NOT NULL GROUP BY 1) x JOIN (SELECT generation_id, arg_min(score, response_id) AS b FROM resp WHERE generation_id IS NOT NULL AND score IS NOT NULL GROUP BY 1) y USING (generation_id)),
 r AS (SELECT run_id, cover.coverage, l.p95, g.*, share FROM cover JOIN (SELECT run_id, {_LAT} GROUP BY 1) l USING (run_id) JOIN g USING (run_id), agreed),
 u AS (SELECT run_id, unnest([{{'gate': 'covered', 'kind': 'coverage', 'severity': 'blocking', 'passed': coverage >= 0.2}}, {{'gate': 'harness', 'kind': 'harness_failure_rate', 'severity': 'blocking', 'passed': failing <= 0.002}}, {{'gate': 'quality', 'kind': 'quality_floor', 'severity': 'blocking', 'passed': coalesce(exact >= 0.55, false)}},
  {{'gate': 'fast', 'kind': 'latency', 'severity': 'informational', 'passed': p95 <= 9000}}, {{'gate': 'cheap', 'kind': 'cost', 'severity': 'informational', 'passed': unpriced = 0 AND usd <= 2000}}, {{'gate': 'judge', 'kind': 'calibrated_judge', 'severity': 'blocking', 'passed': share >= 0.2}}]) AS x FROM r)
SELECT run_id, x.gate AS gate, x.kind AS kind, x.severity AS severity, x.passed AS passed, NOT x.passed AND x.severity = 'blocking' AS blocking_failure FROM u""",
    "deterministic_sample": f"WITH {CASES_SQL}, r AS (SELECT case_id, task_type FROM cases ORDER BY sha256('7:' || case_id), case_id LIMIT 50) SELECT * FROM r",
    "first_writer_wins": "WITH o AS (SELECT example_id, arg_min(outcome, loaded_at) AS outcome, min(loaded_at) AS l FROM qa_baseline GROUP BY 1) SELECT outcome, count(*) AS n FROM o GROUP BY 1",
    "last_writer_wins": "WITH o AS (SELECT case_id, arg_max(task_type, loaded_at) AS task_type, arg_max_null(deleted_at, loaded_at) AS deleted_at FROM eval_cases GROUP BY 1) SELECT task_type, count(*) AS n, count(deleted_at) AS n_deleted FROM o GROUP BY 1",
}
NO_SQL = ("delta_interval", "metric_interval")
QUERIES = {name: globals()[name] for name in (*ORACLE, *NO_SQL)}
