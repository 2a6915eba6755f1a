"""Connected components of small graphs such as that of compared models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.session import materialize


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node of each component, by spreading least labels along the edges until none changes.

    For graphs of named things (models, runs). Every round is written to the shared folder, so the plan does
    not grow and a lost executor costs no round.
    """
    both = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "graph-edges")
    labels = nodes.select(F.col("node"), F.col("node").alias("component")).distinct()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        nxt = materialize(spread, "graph-labels")
        if not nxt.where("moved").head(1):
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")
    raise RuntimeError("labels still change")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): different neighbours of each node, loops aside; one without any has 0."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("y"))).where("node <> y").distinct()
    n = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").distinct().join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
