"""Columns of doubles that a query and its SQL are compared by: both sides are rounded, as sums run in another order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
DOUBLES = {
    "pass_rate_overall": "pass_rate ci_low ci_high",
    "pass_rate_by_slice": "ci_low ci_high",
    "slice_rollup_wilson": "value ci_low ci_high stddev",
    "coverage_publishable": "coverage",
    "outcome_histogram_pct": "pct",
    "latency_percentiles": "p50 p90 p95 p99 max_ms mean_ms",
    "latency_by_run": "p50 p90 p95 p99 max_ms mean_ms",
    "retries_cache_rate": "cache_rate",
    "known_and_unknown_sums": "total",
    "headline_quality": "value ci_low ci_high",
    "per_metric_aggregates": "mean stddev",
    "paired_compare": "baseline_rate candidate_rate delta relative_delta p_value cohens_h",
    "paired_compare_counts": "baseline_rate candidate_rate delta",
    "mcnemar_exact": "p_value",
    "effect_sizes": "delta relative_delta cohens_h",
    "benjamini_hochberg": "p_value",
    "between_repeat_variance": "variance",
    "pass_at_3": "pass_at_3",
    "slices_weakest_first": "value",
    "leaderboard": "value",
    "quality_tables": "value",
    "gate_evaluation": "measured",
    "exact_match": "value",
    "squad_f1": "value",
    "normalized_levenshtein": "value",
    "assertions": "value",
    "numeric_assertion": "value",
    "json_validity": "value",
    "json_field_f1_flat": "value",
    "classification_match": "value",
    "rouge_1": "value",
    "rouge_2": "value",
    "sacrebleu_corpus": "bleu",
    "classification_report": "accuracy balanced_accuracy macro_f1 micro_f1 weighted_precision weighted_recall weighted_f1 mcc kappa",
    "cohen_kappa": "kappa",
    "spearman": "rho",
    "krippendorff_nominal": "alpha",
    "krippendorff_ordinal": "alpha",
    "adaptive_ece": "adaptive_ece",
    "reliability_bins": "accuracy confidence",
    "brier_nll": "brier nll",
    "risk_coverage": "p coverage risk",
    "risk_coverage_aurc": "aurc",
    "accuracy_at_80": "accuracy_at_80",
    "roc_auc": "roc_auc",
    "pr_auc": "pr_auc",
    "calibrate_threshold": "threshold f1",
    "win_rates": "win_rate",
    "position_bias": "first_share",
    "swap_consistency": "consistency",
    "nearest_neighbours": "cosine",
    "ndcg_at_10": "value",
    "precision_at_k": "value",
    "recall_at_20": "value",
    "mrr": "value",
    "map": "value",
    "cosine_max_reference": "value",
    "centroid_similarity": "value",
    "context_precision_recall": "context_precision context_recall",
    "unsupported_claim_rate": "unsupported_rate",
    "citation_attribution": "attribution",
    "mock_provider": "total_ms",
    "tumbling_event_counts": "total",
    "percent_of_total": "pct",
}


def rounded(name: str, df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in DOUBLES.get(name, "").split()}) if name in DOUBLES else df


def rounded_sql(name: str, sql: str) -> str:
    """The SQL with the same columns rounded; adding 0 makes a negative zero positive."""
    if name not in DOUBLES:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) + 0 AS {c}' for c in DOUBLES[name].split())}) FROM ({sql}) AS q"
