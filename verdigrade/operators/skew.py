"""Equi-joins in which a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than an equal part of the rows of so many tasks, or of the session's shuffle partitions if they are more.
LEAST_PARTS = 128


def parts(spark: SparkSession) -> int:
    """Into how many tasks of equal size the rows of a shuffle should fall."""
    return max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counts: DataFrame, key: str, n: str = "n", one_in: int | None = None) -> DataFrame:
    """Of counts (one row a key), the keys holding at least 1/one_in of all rows, and _salts: over how many tasks such a key is spread.

    There are never more than one_in of them, and their salts together are at most twice as many.
    Null keys and empty tables give no hot key.
    """
    one_in = one_in or parts(counts.sparkSession)
    total = counts.agg(F.sum(n).alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col(key).isNotNull() & (F.col(n) * one_in >= F.col("_total")))
        .select(key, F.greatest(F.lit(1), F.ceil(F.col(n) * one_in / F.col("_total"))).cast("int").alias("_salts"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: DataFrame, spread: Sequence[Column]) -> DataFrame:
    """left joined with right on key; rows of left with a hot key go to as many tasks as its salts in place of one.

    hot: see hot_keys, a bounded number of rows, which alone is broadcast. Rows of right with a hot key are
    repeated once a salt, all others stay single. how: inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join can't do a {how} join")
    flag = F.broadcast(hot.select(key, "_salts"))
    one = left.join(flag, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int"))
    many = right.join(flag, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return one.drop("_salts").join(many.drop("_salts"), [key, "_salt"], how).drop("_salt")
