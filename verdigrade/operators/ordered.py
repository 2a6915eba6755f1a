"""Running sums and ranks over a total order without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(groups: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False, buckets: int = 4096) -> DataFrame:
    """groups with run_<sum> columns: each sum over all rows up to and with the own one in the order.

    groups: one row a distinct value of `order` (aggregate ties first), so the size is that of distinct
    values. The values' range is cut into buckets by value; sums of buckets (at most `buckets` rows a key)
    are accumulated in a small window, rows only within their bucket, and both are added. Null orders are
    left out; NaN sorts last, as in Spark.
    """
    g = groups.where(F.col(order).isNotNull())
    span = g.groupBy(*keys).agg(F.min(F.nanvl(F.col(order).cast("double"), F.lit(None).cast("double"))).alias("_lo"), F.max(F.when(~F.isnan(F.col(order).cast("double")), F.col(order).cast("double"))).alias("_hi"))
    if keys:
        g = g.join(span, list(keys))
    else:
        g = g.crossJoin(F.broadcast(span))  # one row
    x = F.col(order).cast("double")
    at = F.when(F.isnan(x), F.lit(buckets)).otherwise(F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * buckets))).cast("int")
    g = g.withColumn("_b", F.coalesce(at, F.lit(0)) * (-1 if descending else 1)).drop("_lo", "_hi")
    per = g.groupBy(*keys, "_b").agg(*(F.sum(s).alias(f"_all_{s}") for s in sums))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *(F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums))
    first = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "_b").orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(per, [*keys, "_b"])
    out = g.select("*", *((F.sum(s).over(inside) + F.col(f"_before_{s}")).alias(f"run_{s}") for s in sums))
    return out.drop("_b", *(f"_before_{s}" for s in sums))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order, kept as a heap a task; n is the feature of a report."""
    return df.orderBy(*order).limit(n)
