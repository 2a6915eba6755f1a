"""Judgments of single answers and of pairs shown in both orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def original_preference(preference: Column, swap: Column) -> Column:
    """The preference in terms of the unswapped pair: A and B change places where the pair was shown swapped."""
    return F.when((swap == 1) & (preference == "A"), "B").when((swap == 1) & (preference == "B"), "A").otherwise(preference)


def win_rates(items: DataFrame) -> DataFrame:
    """(model, wins, decided, win_rate) over items (model_a, model_b, preference) that aren't ties; one row fans out to its two models."""
    sides = F.array(F.struct(F.col("model_a").alias("model"), (F.col("preference") == "A").alias("won")), F.struct(F.col("model_b").alias("model"), (F.col("preference") == "B").alias("won")))
    g = items.where(F.col("preference").isin("A", "B")).select(F.explode(sides).alias("x")).select("x.*").groupBy("model").agg(F.count_if("won").alias("wins"), F.count(F.lit(1)).alias("decided"))
    return g.withColumn("win_rate", F.col("wins") / F.col("decided"))


def position_bias(items: DataFrame) -> DataFrame:
    """(n_decided, first_share): how often the answer shown first is preferred, ties left out; null if all are ties."""
    d = items.where(F.col("shown").isin("A", "B"))
    return d.agg(F.count(F.lit(1)).alias("n_decided"), F.avg((F.col("shown") == "A").cast("double")).alias("first_share"))


def swap_consistency(items: DataFrame, key: str) -> DataFrame:
    """(n_pairs, consistency): share of pairs judged in both orders whose resolved preference is the same."""
    g = items.groupBy(key).agg(F.count_distinct("swap").alias("orders"), F.count_distinct("preference").alias("views")).where("orders = 2")
    return g.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("views") == 1).cast("double")).alias("consistency"))


def require_total(joined: DataFrame, column: str, what: str) -> DataFrame:
    """The rows, or an error naming what is missing once a row without `column` is met."""
    return joined.where(F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{what} is missing")).cast("boolean")).otherwise(F.lit(True)))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that may occur once a side; a repeated key is an error."""
    once = lambda df: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in df.columns if c != key)).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} occurs more than once"))).otherwise(F.col(key))).drop("_n")
    return once(left).join(once(right), key)


def calibration_gate(stats: DataFrame, agreement: str, least: float, min_holdout: int, min_dev: int) -> DataFrame:
    """stats (n_dev, n_holdout, judge_family, candidate_family, agreement) with `reasons` and whether gating is allowed."""
    same = F.lower(F.btrim("judge_family")) == F.lower(F.btrim("candidate_family"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_dev") < min_dev, "too few dev labels"), F.when(F.col("n_holdout") < min_holdout, "too few holdout labels"), F.when(same, "judge and candidate are of one family"),
            F.when(F.col(agreement).isNull(), "agreement is undefined").when(F.col(agreement) < least, "agreement is too low"),
        )
    )
    return stats.withColumn("reasons", reasons).withColumn("gating_allowed", F.size("reasons") == 0)
