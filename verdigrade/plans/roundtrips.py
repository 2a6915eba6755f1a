"""Readers and writers on whole tables: a table is written in a public format and read back through its adapter."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions.text import shown_reference, token_estimate
from verdigrade.operators import artifacts, sinks
from verdigrade.plans import views as v
from verdigrade.plans.views import CASES_SQL
from verdigrade.session import own_folder, table
from verdigrade.sources import datasets, schemas


def _place(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = _place(spark, name)
    lines.write.text(path)
    return path


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages, a fixed table of a few hundred, as one line each without the signs that the formats use."""
    return table(spark, d, "holdout_passages").select("item_id", "dataset_name", "task_type", F.btrim(F.regexp_replace("item_text", r'[\s@"\\]+', " ")).alias("text"))


def _summed(cases: DataFrame, label: str, text: str) -> DataFrame:
    return cases.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("inputs")[text])).alias("n_chars"))


def adapter_squad(spark: SparkSession, d: str) -> DataFrame:
    answers = F.filter(F.array(F.struct(F.col("task_type").alias("text"), F.lit(0).alias("answer_start"))), lambda _: F.col("item_id") % 3 != 0)
    qa = F.struct(F.col("item_id").cast("string").alias("id"), F.col("dataset_name").alias("question"), answers.alias("answers"))
    article = F.struct(F.lit("t").alias("title"), F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))
    whole = _passages(spark, d).agg(F.to_json(F.struct(F.collect_list(article).alias("data"))).alias("value"))  # the format is one JSON value
    return _summed(datasets.squad(spark, _written(spark, whole, "squad")), "reference_answer", "context")


def adapter_finqa(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("item_id").cast("string").alias("id"), F.array("text").alias("pre_text"), F.array(F.lit("end")).alias("post_text"), F.struct(F.col("dataset_name").alias("question"), F.col("task_type").alias("answer")).alias("qa"))
    whole = _passages(spark, d).agg(F.to_json(F.collect_list(row)).alias("value"))
    return _summed(datasets.finqa(spark, _written(spark, whole, "finqa")), "reference_answer", "context")


def adapter_pubmedqa(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("item_id").cast("string").alias("key"), F.struct(F.col("dataset_name").alias("QUESTION"), F.array("text", F.lit("end")).alias("CONTEXTS"), F.col("task_type").alias("final_decision")).alias("value"))
    whole = _passages(spark, d).agg(F.to_json(F.map_from_entries(F.collect_list(row))).alias("value"))
    return _summed(datasets.pubmedqa(spark, _written(spark, whole, "pubmedqa")), "expected_label", "context")


def adapter_ag_news(spark: SparkSession, d: str) -> DataFrame:
    lines = _passages(spark, d).select(F.format_string('%d,"%s","%s"', (F.col("item_id") % 4 + 1).cast("int"), F.col("dataset_name"), F.col("text")).alias("value"))
    return _summed(datasets.ag_news(spark, _written(spark, lines, "ag-news")), "expected_label", "text")


def adapter_phrasebank(spark: SparkSession, d: str) -> DataFrame:
    lines = _passages(spark, d).select(F.concat_ws("@", "text", "task_type").alias("value"))
    return _summed(datasets.phrasebank(spark, _written(spark, lines, "phrasebank")), "expected_label", "text")


def adapter_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = v.cand(spark, d)
    lines = c.select(F.to_json(F.struct(F.col("generation_id").alias("id"), F.when(F.length("generation_id") % 2 == 0, F.col("candidate_text")).alias("document"), F.col("candidate_text").alias("article"), F.col("reference").alias("highlights"))).alias("value"))
    got = datasets.summaries(spark, _written(spark, lines, "summaries"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count("reference_answer").alias("n_references"), F.sum(F.length(F.col("inputs")["document"])).alias("n_chars"))


def jsonl_cases(spark: SparkSession, d: str) -> DataFrame:
    c = v.cases(spark, d)
    lines = c.select(F.to_json(F.struct(F.col("case_id").alias("id"), "task_type", F.from_json("inputs", "map<string,string>").alias("inputs"), "reference_answer", "slices", "weight")).alias("value"))
    got = datasets.read_jsonl(spark, _written(spark, lines, "cases"), schemas.CASE)
    return got.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.count("reference_answer").alias("n_references"), F.sum(F.coalesce(F.size("slices"), F.lit(0))).alias("n_slices"), F.round(F.sum("weight"), 6).alias("weight"))


def appended_orders(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries appended to a partitioned table; of a key in both the first stays."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = _place(spark, "orders")
    sinks.append_first_wins(spark, path, o.where("o_orderkey % 3 <> 0").withColumn("delivery", F.lit(1)), ["o_orderkey", "o_orderpriority"], ["o_orderpriority"])
    sinks.append_first_wins(spark, path, o.where("o_orderkey % 2 = 0").withColumn("delivery", F.lit(2)), ["o_orderkey", "o_orderpriority"], ["o_orderpriority"])
    return spark.read.parquet(path).groupBy("o_orderpriority", "delivery").agg(F.count(F.lit(1)).alias("n"))


def upserted_orders(spark: SparkSession, d: str) -> DataFrame:
    """A later delivery replaces the rows of its keys in the partitions that it touches."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    path = _place(spark, "orders")
    sinks.upsert_partitions(spark, path, o.withColumn("delivery", F.lit(1)), ["o_orderkey"], "o_orderpriority")
    sinks.upsert_partitions(spark, path, o.where("o_orderkey % 2 = 0 and o_orderpriority < '3'").withColumn("delivery", F.lit(2)), ["o_orderkey"], "o_orderpriority")
    return spark.read.parquet(path).groupBy("o_orderpriority", "delivery").agg(F.count(F.lit(1)).alias("n"))


def undeclared_models(spark: SparkSession, d: str) -> DataFrame:
    """Names that the judgments use and no table declares."""
    j = v.judged(spark, d).select("judge_model")
    return artifacts.missing_references(j, "judge_model", table(spark, d, "model_versions"), "model")


def small_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Cases that keep the bounds of inputs and references."""
    c = v.cases(spark, d).select("case_id", F.from_json("inputs", "map<string,string>").alias("inputs"), "reference_answer", F.lit(None).cast("string").alias("expected_label"), F.lit(None).cast("array<string>").alias("references"))
    return datasets.within_bounds(c, 60, 20).agg(F.count(F.lit(1)).alias("n"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return v.cases(spark, d).groupBy("task_type").agg(F.sum(token_estimate(F.col("inputs"))).alias("tokens"))


def shown_references(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    shown = shown_reference(F.col("reference_answer"), F.col("task_type"), none, F.lit(None).cast("array<string>"))
    return v.cases(spark, d).select("case_id", shown.alias("shown"))


_TEXT = r"""trim(regexp_replace(item_text, '[\s\x0b\x{85}\p{Z}@"\\]+', ' ', 'g'))"""
_P = f"WITH p AS (SELECT item_id, dataset_name, task_type, {_TEXT} AS t FROM holdout_passages)"
ORACLE = {
    "adapter_squad": f"{_P} SELECT task_type AS label, count(*) AS n, sum(len(t)) AS n_chars FROM p WHERE item_id % 3 <> 0 GROUP BY 1",
    "adapter_finqa": f"{_P} SELECT task_type AS label, count(*) AS n, sum(len(t) + 4) AS n_chars FROM p GROUP BY 1",
    "adapter_pubmedqa": f"{_P} SELECT task_type AS label, count(*) AS n, sum(len(t) + 4) AS n_chars FROM p GROUP BY 1",
    "adapter_ag_news": f"{_P} SELECT ['World', 'Sports', 'Business', 'Sci/Tech'][item_id % 4 + 1] AS label, count(*) AS n, sum(len(dataset_name) + 1 + len(t)) AS n_chars FROM p GROUP BY 1",
    "adapter_phrasebank": f"{_P} SELECT task_type AS label, count(*) AS n, sum(len(t)) AS n_chars FROM p GROUP BY 1",
    "adapter_summaries": f"WITH {v.CAND_SQL} SELECT count(*) AS n, count(reference) AS n_references, sum(len(candidate_text)) AS n_chars FROM cand",
    "jsonl_cases": f"WITH {CASES_SQL} SELECT task_type, count(*) AS n, count(reference_answer) AS n_references, sum(coalesce(cardinality(slices), 0))::BIGINT AS n_slices, round(sum(weight), 6) AS weight FROM cases GROUP BY 1",
    "appended_orders": "SELECT o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS delivery, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1, 2",
    "upserted_orders": "SELECT o_orderpriority, CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority < '3' THEN 2 ELSE 1 END AS delivery, count(*) AS n FROM orders GROUP BY 1, 2",
    "undeclared_models": f"WITH {v.JUDGE_SQL} SELECT DISTINCT judge_model FROM judged WHERE judge_model IS NOT NULL AND judge_model NOT IN (SELECT model FROM model_versions WHERE model IS NOT NULL)",
    "small_datasets": f"WITH {CASES_SQL} SELECT count(*) AS n FROM cases WHERE coalesce(len(reference_answer), 0) <= 20 AND list_max(list_transform(json_keys(inputs), lambda k: coalesce(len(json_extract_string(inputs, '$.\"' || k || '\"')), 0))) <= 60",
    "token_estimates": f"WITH {CASES_SQL} SELECT task_type, sum(greatest(1, (len(inputs) + 2) // 3) + 512)::BIGINT AS tokens FROM cases GROUP BY 1",
    "shown_references": f"WITH {CASES_SQL} SELECT case_id, coalesce(nullif(reference_answer, ''), task_type) AS shown FROM cases",
}
QUERIES = {name: globals()[name] for name in ORACLE}
