"""Queries of problems 2 to 8 over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions.keys import norm_key
from verdigrade.llm import leaks as leak
from verdigrade.llm import overlap, packing, pairs, quantiles, residue, splits
from verdigrade.session import materialize, table

#: The model whose context window is the capacity of the containers of problem 6.
CONTAINER_MODEL = "wren-base"
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _label_entities() -> dict:
    return {"case": norm_key(F.col("case_id")), "set": F.col("label_set_id")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    torn = splits.torn_groups(table(spark, sf_dir, "labels_dev"), "label_id", _label_entities(), "split")
    return torn.select(F.col("record").alias("label_id"))


def p2_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.assign_splits(table(spark, sf_dir, "labels_dev"), "label_id", _label_entities(), F.col("label_value"), SHARES)
    return out.select(F.col("record").alias("label_id"), F.col("grp").alias("group_id"), "split")


def p2_label_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels_dev")
    assigned = splits.assign_splits(labels, "label_id", _label_entities(), F.col("label_value"), SHARES)
    return splits.label_deviation(assigned, labels, "label_id", F.col("label_value"), SHARES).withColumnRenamed("stratum", "label_value")


def p2_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any right assignment: every label id once, no key in two splits, sizes near their shares."""
    labels = table(spark, sf_dir, "labels_dev")
    assigned = materialize(splits.assign_splits(labels, "label_id", _label_entities(), F.col("label_value"), SHARES), "assigned")
    edges = splits.entity_edges(labels, "label_id", _label_entities())
    torn = edges.join(assigned, "record").groupBy("entity").agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n_torn"))
    sizes = assigned.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record").alias("n_labels"), *(F.count_if(F.col("split") == s).alias(s) for s in SHARES))
    near = [F.abs(F.col(s) - x * F.col("n_rows")) <= 0.02 * F.col("n_rows") + 1 for s, x in SHARES.items()]
    return sizes.crossJoin(torn).select("n_rows", "n_labels", "n_torn", (near[0] & near[1] & near[2]).alias("sizes_near_shares"))  # one row each


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = table(spark, sf_dir, "candidates_calibration"), table(spark, sf_dir, "qa_baseline")
    return c.select(F.lit("candidates_calibration").alias("pair_table"), norm_key(F.col("generation_id")).alias("pair_id"), F.col("prompt").alias("question"), F.col("candidate_text").alias("answer")).unionByName(
        q.select(F.lit("qa_baseline").alias("pair_table"), F.col("example_id").cast("string").alias("pair_id"), F.col("input").alias("question"), F.col("output").alias("answer"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, sf_dir)).select("pair_table", "pair_id", "defect")


def p3_defects_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("pair_table", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.latencies(table(spark, sf_dir, "qa_baseline"), "example_id", "latency_ms", "task_type", "generated_at")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, and with day null combined over days: the daily sketches are kept and merged, no value is read again."""
    daily = materialize(quantiles.sketches(_latencies(spark, sf_dir), ["grp", "period"]), "daily-sketches")
    combined = quantiles.merge(daily, ["grp"]).withColumn("period", F.lit(None).cast("date"))
    both = quantiles.percentiles(daily, ["grp", "period"]).unionByName(quantiles.percentiles(combined, ["grp", "period"]))
    return both.withColumnsRenamed({"grp": "task_type", "period": "day"})


def p4_ranks_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latencies(spark, sf_dir)
    daily = quantiles.sketches(rows, ["grp", "period"])
    answers = quantiles.percentiles(quantiles.merge(daily, ["grp"]), ["grp"])
    return quantiles.ranks_within(rows, answers, ["grp"]).withColumnRenamed("grp", "task_type")


def _split_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "candidates_calibration")
    return overlap.split_texts(records, table(spark, sf_dir, "labels_dev"), "generation_id", "case_id", "candidate_text", "case_id", "split", "dev", "holdout"), records


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.overlaps(_split_texts(spark, sf_dir)[0], divisor=overlap.DIVISOR)
    return found.select(F.least("train_id", "eval_id").alias("generation_id_1"), F.greatest("train_id", "eval_id").alias("generation_id_2")).distinct()


def p5_overlaps_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, records = _split_texts(spark, sf_dir)
    return overlap.link_report(*overlap.overlap_links(texts, divisor=overlap.DIVISOR), records, "generation_id", "source")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, sf_dir, "model_versions"), CONTAINER_MODEL)
    return packing.pack(table(spark, sf_dir, "documents"), capacity)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, sf_dir, "model_versions"), CONTAINER_MODEL)
    return packing.packing_report(packing.pack(table(spark, sf_dir, "documents"), capacity), capacity)


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, sf_dir, "model_versions"), CONTAINER_MODEL)
    return packing.mixture_report(packing.pack(table(spark, sf_dir, "documents"), capacity))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any right packing: every document whole in it, no container over its capacity, no document split that fits."""
    docs = table(spark, sf_dir, "documents")
    capacity = packing.capacity_of(table(spark, sf_dir, "model_versions"), CONTAINER_MODEL)
    packed = materialize(packing.pack(docs, capacity), "containers")
    full = packed.groupBy("container_id").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("n_over"))
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"))
    split = whole.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") != F.col("n_pieces")).alias("n_broken"), F.count_if((F.col("n_pieces") > 1) & (F.col("tokens") <= capacity)).alias("n_split_needlessly"))
    return split.crossJoin(full)  # one row each


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "holdout_passages")).where("exact").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "holdout_passages"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("longest_run").alias("longest_run"), F.max("score").alias("best_score"))


def p7_documents_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_split_assignment, p2_label_deviation, p2_split_checks, p3_found, p3_defects_by_table, p4_percentiles, p4_ranks_within_bound,
        p5_found, p5_overlaps_by_source, p6_containers, p6_fill, p6_mixture, p6_checks, p7_found, p7_leaked_items, p7_documents_by_item, p8_found, p8_clean_corpus,
    )
}

_LABELS = r"""WITH RECURSIVE l AS (SELECT label_id, 'c' || nullif(lower(trim(case_id, E' \t\n\r\x0b\x0c')), '') AS c, 's' || label_set_id AS s, lower(trim(split, E' \t\n\r\x0b\x0c')) AS split FROM labels_dev),
e AS (SELECT DISTINCT c AS a, s AS b FROM l WHERE c IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT s, c FROM l WHERE c IS NOT NULL AND s IS NOT NULL),
n AS (SELECT c AS x FROM l WHERE c IS NOT NULL UNION SELECT s FROM l WHERE s IS NOT NULL),
r AS (SELECT x, x AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
g AS (SELECT x, min(y) AS g FROM r GROUP BY x),
m AS (SELECT l.label_id, l.split, coalesce(g.g, 'l' || l.label_id) AS g FROM l LEFT JOIN g ON coalesce(l.c, l.s) = g.x)
"""
_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '[''’‘`´]', '', 'g')), '[\p{{L}}\p{{N}}\p{{M}}]+')"

_P7 = (
    f"WITH d AS (SELECT doc_id AS id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id AS id, {_WORDS.format('item_text')} AS w FROM holdout_passages),\n"
    "dg AS (SELECT DISTINCT id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) > 11)),\n"
    "ig AS (SELECT DISTINCT id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) > 11))\n"
    "SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)"
)

ORACLE = {
    "p2_split_checks": "SELECT count(DISTINCT label_id) AS n_rows, count(DISTINCT label_id) AS n_labels, 0::BIGINT AS n_torn, true AS sizes_near_shares FROM labels_dev",
    "p6_checks": "SELECT count(*) AS n_documents, 0::BIGINT AS n_broken, 0::BIGINT AS n_split_needlessly, 0::BIGINT AS n_over FROM documents",
    "p7_documents_by_item": f"SELECT item_id, count(*) AS n_documents FROM ({_P7}) GROUP BY item_id",
    "p2_found": _LABELS + "SELECT DISTINCT label_id FROM m WHERE g IN (SELECT g FROM m WHERE split IN ('dev', 'holdout') GROUP BY g HAVING count(DISTINCT split) = 2)",
    "p4_ranks_within_bound": """WITH v AS (SELECT example_id, min({'t': task_type, 'v': latency_ms}) AS r FROM qa_baseline GROUP BY 1)
SELECT r.t AS task_type, count(*) AS n, q.level::DOUBLE AS level, true AS within FROM v, (VALUES (0.5), (0.9), (0.95), (0.99)) q(level)
WHERE r.v IS NOT NULL AND NOT isnan(r.v) AND r.v >= 0 GROUP BY r.t, q.level""",
    "p7_found": _P7,
}
