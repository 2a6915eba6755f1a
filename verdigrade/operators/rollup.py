"""Scores rolled up over all cases and by slice, with intervals; confusion matrices and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.functions.stats import wilson

OVERALL = "__overall__"


def wide_to_long(scores: DataFrame, keys: Sequence[str], metrics: dict[str, float]) -> DataFrame:
    """(keys..., metric, value, threshold): one row a metric from a column a metric."""
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in metrics.items()))
    return scores.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*")


def kept_dimensions(cases: DataFrame, slices: str = "slices", most: int = 50) -> DataFrame:
    """(dimension, n_values): the slice dimensions of at most `most` distinct values; null maps have none."""
    return cases.select(F.explode(F.col(slices)).alias("dimension", "v")).groupBy("dimension").agg(F.count_distinct("v").alias("n_values")).where(F.col("n_values") <= most)


def by_slice(rows: DataFrame, slices: str, dimensions: DataFrame, sums: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """(keys..., slice, sums...) over all rows and for each value of each kept dimension.

    Rows are summed per combination of slices first, and only the combinations, not the rows, fan out to
    their dimensions; `sums` are named sums (of counts, values, squares), so the second step adds them up.
    """
    entries = F.array_sort(F.map_entries(F.coalesce(F.col(slices), F.create_map().cast("map<string,string>"))))
    first = rows.withColumn("_s", entries).groupBy(*keys, "_s").agg(*sums)
    names = [c for c in first.columns if c not in (*keys, "_s")]
    fanned = first.select(*keys, *names, F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("").alias("value"))), F.transform("_s", lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))).alias("e"))
    kept = dimensions.select(F.col("dimension"), F.lit(True).alias("_kept"))
    fanned = fanned.join(kept, F.col("e.key") == F.col("dimension"), "left").where(F.col("e.key").isNull() | F.col("_kept"))
    label = F.when(F.col("e.key").isNull(), F.lit(OVERALL)).otherwise(F.concat(F.col("e.key"), F.lit("="), F.col("e.value")))
    return fanned.withColumn("slice", label).groupBy(*keys, "slice").agg(*(F.sum(n).alias(n) for n in names))


def score_sums() -> tuple[Column, ...]:
    """Sums of `value` against `threshold` from which mean, deviation and share follow."""
    return (
        F.count("value").alias("n"),
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.count_if(F.col("value") >= F.col("threshold")).alias("n_passed"),
    )


def score_rollup(scores: DataFrame, keys: Sequence[str], dimensions: DataFrame, slices: str = "slices", rates: Sequence[str] = ()) -> DataFrame:
    """(keys..., slice, n, value, ci_low, ci_high, stddev): mean, interval of the share at or above the threshold, population deviation.

    scores: keys, slices, value, threshold. Null values are left out of n; a slice without values has n 0,
    value 0, interval (0, 0) and no deviation. The metrics in `rates` are shares of right answers: they have
    no deviation, and no interval where there is no value.
    """
    s = by_slice(scores, slices, dimensions, score_sums(), keys)
    n = F.col("n").cast("double")
    mean = F.coalesce(F.try_divide(F.col("total"), n), F.lit(0.0))
    low, high = wilson(F.col("n_passed"), F.col("n"))
    deviation = F.when(F.col("n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares"), n) - mean * mean)))
    if rates:
        rate = F.col("metric").isin(*rates)
        low, high = (F.when(~rate | (F.col("n") > 0), x) for x in (low, high))
        deviation = F.when(~rate, deviation)
    return s.select(*keys, "slice", "n", mean.alias("value"), low.alias("ci_low"), high.alias("ci_high"), deviation.alias("stddev"))


def sliced_rows(rows: DataFrame, slices: str, dimensions: DataFrame) -> DataFrame:
    """rows with `slice`: each row once overall and once for each value of a kept dimension, for aggregates that don't add up."""
    entries = F.map_entries(F.coalesce(F.col(slices), F.create_map().cast("map<string,string>")))
    parts = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("").alias("value"))), F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    fanned = rows.withColumn("_e", F.explode(parts)).join(dimensions.select("dimension", F.lit(True).alias("_kept")), F.col("_e.key") == F.col("dimension"), "left")
    fanned = fanned.where(F.col("_e.key").isNull() | F.col("_kept"))
    return fanned.withColumn("slice", F.when(F.col("_e.key").isNull(), F.lit(OVERALL)).otherwise(F.concat(F.col("_e.key"), F.lit("="), F.col("_e.value")))).drop("_e", "_kept", "dimension")


def confusion(rows: DataFrame, expected: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., expected, predicted, n); rows without either label are left out."""
    return rows.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys, F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """One row of accuracy, balanced accuracy, F1 averages, weighted precision and recall, MCC and kappa.

    matrix: confusion() without keys, labels squared at most; everything follows from it and not from rows.
    """
    exp = matrix.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("support"))
    pre = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = matrix.where("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("hits"))
    per = exp.join(pre, "label", "full").join(hit, "label", "left").na.fill(0)
    p = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0))
    per = per.select("*", p.alias("p"), r.alias("r"), f1.alias("f1"))
    a = per.agg(
        F.sum("support").cast("double").alias("n"), F.sum("hits").cast("double").alias("h"), F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        *(F.sum(F.col(c) * F.col("support")).alias(f"w{c}") for c in ("p", "r", "f1")),
        F.sum(F.col("predicted") * F.col("support")).cast("double").alias("ps"), F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"), F.sum(F.col("support") * F.col("support")).cast("double").alias("ss"),
    )
    n, h = F.col("n"), F.col("h")
    spread = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("ss")))
    chance = F.try_divide(F.col("ps"), n * n)
    return a.select(
        n.cast("bigint").alias("n"), F.try_divide(h, n).alias("accuracy"), "balanced_accuracy", "macro_f1", F.try_divide(h, n).alias("micro_f1"),
        F.try_divide(F.col("wp"), n).alias("weighted_precision"), F.try_divide(F.col("wr"), n).alias("weighted_recall"), F.try_divide(F.col("wf1"), n).alias("weighted_f1"),
        F.coalesce(F.try_divide(h * n - F.col("ps"), spread), F.lit(0.0)).alias("mcc"), F.try_divide(F.try_divide(h, n) - chance, 1 - chance).alias("kappa"),
    )
