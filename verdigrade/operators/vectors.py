"""Exact nearest neighbours of a stated query set by blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, vec_id: str, vector: str, per_block: int) -> DataFrame:
    """(block, ids, dim, data): vectors gathered by a hash of their id into blocks of about per_block rows."""
    n = df.count()
    parts = max(1, -(-n // per_block))
    b = F.pmod(F.xxhash64(vec_id), F.lit(parts))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).groupBy(b.alias("block")).agg(F.collect_list(F.struct(F.col(vec_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("rows"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", per_block: int = 4096) -> DataFrame:
    """(query_id, vec_id, cosine, place): each query's k rows of highest cosine, itself left out, ties by id.

    Queries and rows are gathered into blocks of bounded size, and each pair of blocks is one matrix product
    of which only k rows a query go on: the work is that of the stated search, the shuffle k rows a query and
    block. Vectors of another dimension than the query's, of no length or with NaN have no cosine.
    """
    q = blocks(queries, vec_id, vector, per_block).select(F.col("rows").alias("q"))
    r = blocks(rows, vec_id, vector, per_block).select(F.col("rows").alias("r"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qs, rs in zip(f["q"], f["r"]):
                out = []
                for dim in {len(x["v"]) for x in qs}:
                    a, b = ([x for x in xs if len(x["v"]) == dim] for xs in (qs, rs))
                    if not a or not b:
                        continue
                    ai, bi = (np.array([x["id"] for x in xs]) for xs in (a, b))
                    am, bm = (np.stack([np.asarray(x["v"], float) for x in xs]) for xs in (a, b))
                    an, bn = np.sqrt((am * am).sum(1)), np.sqrt((bm * bm).sum(1))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        sim = am @ bm.T / an[:, None] / bn[None, :]
                    for i, own in enumerate(ai):
                        ok = np.flatnonzero(np.isfinite(sim[i]) & (bi != own))
                        best = ok[np.lexsort((bi[ok], -np.round(sim[i][ok], 12)))[:k]]
                        out.append(pd.DataFrame({"query_id": own, "vec_id": bi[best], "cosine": sim[i][best]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    # Blocks, not rows, are paired: the stated query set against all rows.
    found = q.crossJoin(r).mapInPandas(each, "query_id bigint, vec_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.round("cosine", 12).desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def centroid(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean of the normalised vectors, normalised; vectors of no length are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select(group, F.transform(v, lambda x: F.try_divide(x, norm)).alias("u")).where(F.col("u")[0].isNotNull())
    mean = unit.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    c = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))  # a vector's entries
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return c.select(group, F.transform("c", lambda x: F.try_divide(x, size)).alias("centroid"))
