"""Percentiles with a bounded rank error from mergeable sketches of randomized compactors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the top compactor. The rank of an answer is off by at most rank_error(K) of n with 99 % probability.
K = 1000
LEVELS = (0.5, 0.9, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """Bound of the rank error of one answer as a share of n, at 99 % probability, for compactors of size k.

    The fit published with the sketch's implementation for single-sided queries.
    """
    return 2.296 / k**0.9021


def valid_measure(c: Column) -> Column:
    """Not null, not NaN and not negative; zero and infinity are measures."""
    return c.isNotNull() & ~F.isnan(c) & (c >= 0)


def latencies(df: DataFrame, row_id: str, value: str, group: str, at: str, period: str = "day") -> DataFrame:
    """(grp, period, value), one row an id with a valid value; of differing copies the one with the least values counts."""
    return (
        df.select(F.col(row_id).alias("_id"), F.col(value).cast("double").alias("value"), F.col(group).alias("grp"), F.date_trunc(period, F.col(at)).cast("date").alias("period"))
        .groupBy("_id")
        .agg(F.min(F.struct("grp", "period", "value")).alias("row"))
        .select("row.*")
        .where(valid_measure(F.col("value")))
    )


def sketches(rows: DataFrame, by: Sequence[str], value: str = "value", k: int = K) -> DataFrame:
    """(by..., sketch): one sketch of the values a group.

    A hierarchy of compactors: values enter the lowest; a full one is sorted, and every other of its values,
    from a random start, moves up at twice the weight. The sketch is built by each task for the groups it
    reads and merged level by level, so a group that holds most of the rows leaves each task as one sketch of
    a few kilobytes. Groups may be null, and null is a group of its own. Values must be valid (latencies).
    """
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge(sketched: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of partitions, days or tables combined by the columns `by`; the error bound stays."""
    return sketched.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def percentiles(sketched: DataFrame, by: Sequence[str], levels: Sequence[float] = LEVELS, k: int = K) -> DataFrame:
    """(by..., n, p50, ..., rank_error): answers of each sketch; groups without valid values have no sketch and no row."""
    return sketched.select(
        *by,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_")) for q in levels),
        F.lit(rank_error(k)).alias("rank_error"),
    )


def ranks_within(rows: DataFrame, answers: DataFrame, by: Sequence[str], levels: Sequence[float] = LEVELS, k: int = K, value: str = "value") -> DataFrame:
    """(by..., level, n, within): whether each answer's true rank, counted over all rows, is within the bound.

    A value occupies the ranks of all rows equal to it, so the level must lie within the bound of that span.
    answers: a row a group; it is joined to every row for one pass of counting.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in levels]
    a = answers.select(*[F.col(c).alias(f"_{c}") for c in by], *names)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = rows.join(a, on, "inner")
    counted = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col(value) < F.col(p)).alias(f"{p}_below") for p in names),
        *(F.count_if(F.col(value) <= F.col(p)).alias(f"{p}_upto") for p in names),
    )
    eps = rank_error(k)
    return counted.select(
        *by,
        "n",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(q).alias("level"),
                        ((F.col(f"{p}_below") - 1 <= (q + eps) * F.col("n")) & (F.col(f"{p}_upto") + 1 >= (q - eps) * F.col("n"))).alias("within"),
                    )
                    for q, p in zip(levels, names)
                )
            )
        ).alias("x"),
    ).select(*by, "n", "x.level", "x.within")
