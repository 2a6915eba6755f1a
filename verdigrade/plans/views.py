"""The evaluation tables as the operators want them, and the same as SQL.

A record delivered again counts once: `gen` and `cases` keep one row an id. Runs are the run_ids of
qa_baseline in their order; the first is the baseline and the second the candidate of comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions.keys import norm_key
from verdigrade.session import table

BASELINE, CANDIDATE = "4b1e7139-0000-4000-8000-000000000000", "43b9b54f-0000-4000-8000-000000000001"
_K = r"nullif(lower(trim({}, E' \t\n\r\x0b\x0c')), '')"

GEN_SQL = f"""gen AS (SELECT example_id, run_id, {_K.format('case_id')} AS case_id, repeat_idx, task_type, slices, input, reference, output, outcome, metric, metric_value, passed, latency_ms, trace_id, generated_at
 FROM qa_baseline QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY loaded_at) = 1)"""
CASES_SQL = f"""cases AS (SELECT {_K.format('case_id')} AS case_id, task_type, inputs, reference_answer, slices, weight
 FROM eval_cases WHERE {_K.format('case_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_K.format('case_id')} ORDER BY loaded_at) = 1)"""
CAND_SQL = f"""cand AS (SELECT {_K.format('case_id')} AS case_id, {_K.format('generation_id')} AS generation_id, candidate_text, prompt, reference, source
 FROM candidates_calibration WHERE {_K.format('generation_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_K.format('generation_id')} ORDER BY loaded_at) = 1)"""
JUDGE_SQL = f"""judged AS (SELECT judgment_id, {_K.format('case_id')} AS case_id, {_K.format('generation_id')} AS generation_id, score, outcome, judge_model, judged_at
 FROM judgments QUALIFY row_number() OVER (PARTITION BY judgment_id ORDER BY loaded_at) = 1)"""
RESP_SQL = f"""resp AS (SELECT response_id, {_K.format('generation_id')} AS generation_id, score, responded_at
 FROM mock_judge_responses_calibration QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY loaded_at) = 1)"""
LABEL_SQL = f"""labels AS (SELECT label_id, rubric_name, rubric_version, {_K.format('case_id')} AS case_id, label_shape, label_value, {_K.format('split')} AS split, label_set_id, labeled_at
 FROM labels_dev QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY loaded_at) = 1)"""


def _first(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The earliest delivery of each key, of equally early ones one.

    Columns are aggregated one by one, so those a query doesn't use are neither read nor shuffled; all are taken
    from the row that comes first by time and by its number, which no other row has.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_first", F.struct("loaded_at", F.monotonically_increasing_id().alias("row")))
    return rows.groupBy(key).agg(*(F.min_by(c, "_first").alias(c) for c in columns if c != key))


def gen(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "qa_baseline").withColumn("case_id", norm_key(F.col("case_id")))
    return _first(df, "example_id", [c for c in df.columns if c != "loaded_at"])


def cases(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "eval_cases").withColumn("case_id", norm_key(F.col("case_id")))
    return _first(df, "case_id", ["case_id", "task_type", "inputs", "reference_answer", "slices", "weight"])


def cand(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates_calibration").withColumn("case_id", norm_key(F.col("case_id"))).withColumn("generation_id", norm_key(F.col("generation_id")))
    return _first(df, "generation_id", ["generation_id", "case_id", "candidate_text", "prompt", "reference", "source"])


def judged(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "judgments").withColumn("case_id", norm_key(F.col("case_id"))).withColumn("generation_id", norm_key(F.col("generation_id")))
    return _first(df, "judgment_id", ["judgment_id", "case_id", "generation_id", "score", "outcome", "judge_model", "judged_at"])


def resp(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mock_judge_responses_calibration").withColumn("generation_id", norm_key(F.col("generation_id")))
    return _first(df, "response_id", ["response_id", "generation_id", "score", "responded_at"])


def labels(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels_dev").withColumn("case_id", norm_key(F.col("case_id"))).withColumn("split", norm_key(F.col("split")))
    return _first(df, "label_id", ["label_id", "rubric_name", "rubric_version", "case_id", "label_shape", "label_value", "split", "label_set_id", "labeled_at"])
