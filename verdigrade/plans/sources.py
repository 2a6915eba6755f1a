"""Validation of cases and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigrade.functions.text import prompt_key
from verdigrade.operators import validate
from verdigrade.plans import views as v
from verdigrade.plans.views import CASES_SQL
from verdigrade.session import own_folder, table
from verdigrade.streaming import monitor


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return v.cases(spark, d).withColumn("k", prompt_key(F.from_json("inputs", "map<string,string>")))


def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    c = v.cases(spark, d)
    rules = validate.case_rules(F.col("inputs"), F.col("reference_answer"), F.col("weight"), F.col("slices"), F.col("task_type"), ("domain", "lang"))
    rows = validate.breaches(c, "case_id", rules).unionByName(validate.repeated(_prompts(spark, d), F.col("k"), "case_id", "repeated_prompt"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def duplicate_prompts(spark: SparkSession, d: str) -> DataFrame:
    return validate.repeated(_prompts(spark, d), F.col("k"), "case_id", "repeated_prompt").select("case_id")


def tumbling_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stream is read to its end; of each window the last state counts."""
    base = f"{own_folder(spark)}/tumbling-{uuid.uuid4().hex}"
    counts = monitor.tumbling_counts(monitor.event_stream(spark, d, "events.parquet"), "1 hour", None)
    monitor.update_into(counts, f"{base}/out", f"{base}/checkpoint")
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")
    return out.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r")).select("event_type", "start", "r.n", F.round("r.total", 4).alias("total"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.sessions(e, "30 minutes")


def sliding_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.sliding_counts(e, "1 hour", "15 minutes")


def breaker_replay(spark: SparkSession, d: str) -> DataFrame:
    return monitor.breaker_replay(table(spark, d, "events"), "user_id", "event_type <> 'purchase'", 5, 3600.0)


def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("pct"))


_KEY = """list_sort(list_transform(json_keys(inputs), lambda k: k || ':' || lower(trim(coalesce(json_extract_string(inputs, '$."' || k || '"'), '')))))"""
_PROMPTS = f"WITH {CASES_SQL}, p AS (SELECT case_id, array_to_string({_KEY}, '|') AS k FROM cases), dup AS (SELECT case_id FROM p WHERE k IN (SELECT k FROM p GROUP BY 1 HAVING count(DISTINCT case_id) > 1))"
ORACLE = {
    "validation_rules": f"""{_PROMPTS}, b AS (SELECT 'no_inputs' AS rule FROM cases WHERE inputs IS NULL OR trim(inputs) = '' UNION ALL SELECT 'no_reference' FROM cases WHERE reference_answer IS NULL OR reference_answer = ''
UNION ALL SELECT 'inputs_too_long' FROM cases WHERE len(inputs) > 2000 UNION ALL SELECT 'reference_too_long' FROM cases WHERE len(reference_answer) > 500 UNION ALL SELECT 'weight_not_positive' FROM cases WHERE weight <= 0
UNION ALL SELECT 'undeclared_slices' FROM cases WHERE NOT list_has_all(coalesce(map_keys(slices), []), ['domain', 'lang']) UNION ALL SELECT 'repeated_prompt' FROM dup) SELECT rule, count(*) AS n FROM b GROUP BY 1""",
    "duplicate_prompts": f"{_PROMPTS} SELECT case_id FROM dup",
    "tumbling_event_counts": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "sliding_event_counts": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, range(0, 4) t(i) GROUP BY 1",
    "percent_of_total": "SELECT event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in (*ORACLE, "breaker_replay")}
