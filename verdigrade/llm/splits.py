"""Splits that keep related records together: groups by label propagation, then stratified assignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.functions.keys import norm_key
from verdigrade.operators.skew import hot_keys, salted_join
from verdigrade.session import materialize


def entity_edges(records: DataFrame, record_id: str, entities: dict[str, Column]) -> DataFrame:
    """(record, entity): the bipartite graph of records and what they share; null entities tie nothing.

    entities: by kind, the key of that kind. Keys of different kinds never meet.
    """
    found = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{kind}\u0001"), c.cast("string"))) for kind, c in entities.items())))
    return records.select(F.col(record_id).alias("record"), F.explode(found).alias("entity")).where(F.col("record").isNotNull()).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): the label of a node is the same for all nodes that edges connect, directly or through others.

    Minimum-label propagation on a graph that shrinks: in each round every node takes the least label among
    itself and its neighbours, and then each edge is replaced by that of its ends' labels; loops and
    repetitions vanish. In even rounds nodes with more neighbours count as less, so that stars fold into
    their centres at once; ties, and all of odd rounds, follow a hash drawn anew, which leaves a fraction of
    the nodes whatever the graph, so that chains take a logarithm of their length. A node with very many
    neighbours is pre-aggregated to their least one and its edges are relabelled in salted tasks. Each round
    is written to the shared folder, so nothing before it is computed again.

    Defined results: rows with a null end are left out; loops give the node its own label; an empty table
    gives no row. More than max_rounds rounds raise an error instead of a wrong answer.
    """
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    maps: list[DataFrame] = []
    for number in range(max_rounds):
        if now.isEmpty():
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        first = lambda n: -n if number % 2 == 0 else F.lit(0).cast("bigint")
        ranked = degree.select(F.col("a").alias("b"), F.struct(first(F.col("n")).alias("n"), F.xxhash64("a", F.lit(number)).alias("h"), F.col("a").alias("v")).alias("rank"))
        if number % 2 == 0:
            sides = salted_join(both, ranked, "b", "inner", hot_keys(degree, "a").withColumnRenamed("a", "b"), [F.col("a")])
        else:
            sides = both.withColumn("rank", F.struct(F.lit(0).cast("bigint").alias("n"), F.xxhash64("b", F.lit(number)).alias("h"), F.col("b").alias("v")))
        near = sides.groupBy("a").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n"))
        own = F.struct(first(F.col("n")).alias("n"), F.xxhash64("a", F.lit(number)).alias("h"), F.col("a").alias("v"))
        labels = materialize(near.select(F.col("a").alias("node"), F.least("least", own)["v"].alias("label"), "n"), "labels")
        maps.append(labels)
        hot = hot_keys(labels, "node").withColumnRenamed("node", "a")
        step = salted_join(now, labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "inner", hot, [F.col("b")])
        step = salted_join(step, labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "inner", hot.withColumnRenamed("a", "b"), [F.col("a")])
        now = materialize(step.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    if not maps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # Each round's map is smaller than the one before by a factor, so the maps are put together from the last one.
    out = maps[-1].select("node", "label")
    for earlier in reversed(maps[:-1]):
        counts = earlier.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        joined = salted_join(earlier.select("node", "label"), out.toDF("label", "next"), "label", "left", hot_keys(counts, "label"), [F.col("node")])
        out = materialize(joined.select("node", F.coalesce("next", "label").alias("label")), "groups")
    return out


def related_groups(records: DataFrame, record_id: str, entities: dict[str, Column]) -> DataFrame:
    """(record, grp): records that share an entity, directly or through other records, have the same group.

    A record with one entity only belongs to that entity's group; the entities that records tie together are
    the edges. A record without any entity is a group of its own.
    """
    edges = materialize(entity_edges(records, record_id, entities), "record-entities")
    ends = edges.groupBy("record").agg(F.min("entity").alias("a"), F.sort_array(F.collect_set("entity")).alias("all"))
    ties = ends.where(F.size("all") > 1).select("a", F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("b"))
    groups = connected(ties)
    sizes = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    placed = salted_join(ends.select("record", "a"), groups.select(F.col("node").alias("a"), "label"), "a", "left", hot_keys(sizes, "a"), [F.col("record")])
    placed = placed.select("record", F.coalesce("label", "a").alias("grp"))
    alone = records.select(F.col(record_id).alias("record")).where(F.col("record").isNotNull()).distinct().join(placed.select("record"), "record", "left_anti")
    return placed.unionByName(alone.select("record", F.concat(F.lit("\u0001"), F.col("record").cast("string")).alias("grp")))


def split_name(c: Column) -> Column:
    """A delivered split without case and outer spaces; null where null or blank."""
    return norm_key(c)


def torn_groups(records: DataFrame, record_id: str, entities: dict[str, Column], split: str, apart: Sequence[str] = ("dev", "holdout")) -> DataFrame:
    """(record, grp): every record of a group whose records carry all of the splits in `apart`."""
    groups = materialize(related_groups(records, record_id, entities), "record-groups")
    carried = records.select(F.col(record_id).alias("record"), split_name(F.col(split)).alias("s")).where(F.col("s").isin(*apart)).distinct()
    torn = carried.join(groups, "record").groupBy("grp").agg(F.count_distinct("s").alias("n")).where(F.col("n") == len(apart)).select("grp", F.lit(True).alias("torn"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(groups, torn, "grp", "inner", hot_keys(sizes, "grp"), [F.col("record")]).select("record", "grp")


def _greedy(sizes: np.ndarray, hist: np.ndarray, goal: np.ndarray, filled: np.ndarray) -> list[int]:
    """A split for each group, largest first: where the squared gap between goal and filled shrinks most.

    goal, filled: records by split and stratum. The gap of a stratum counts relative to its goal, so that rare
    strata are spread as well; the gap of a split's size counts as one more stratum.
    """
    scale = 1.0 / np.maximum(goal, 1.0)
    size_goal, size_filled = goal.sum(1), filled.sum(1)
    size_scale = 1.0 / np.maximum(size_goal, 1.0)
    out = [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        h, n = hist[i], sizes[i]
        gap = filled - goal
        cost = ((2 * gap + h) * h * scale).sum(1) + 2 * (2 * (size_filled - size_goal) + n) * n * size_scale
        s = int(np.argmin(cost))
        out[i] = s
        filled[s] += h
        size_filled[s] += n
    return out


def assign_splits(
    records: DataFrame, record_id: str, entities: dict[str, Column], stratum: Column, shares: dict[str, float], groups_per_task: int = 20_000, big_one_in: int = 2000, most_strata: int = 256,
) -> DataFrame:
    """(record, grp, split): every record given to a split; a group is never torn.

    Groups are first summed up to their records by stratum. Those holding at least 1/big_one_in of all records,
    at most big_one_in of them, are placed first on the driver; the rest in parallel tasks of hashed groups,
    each of which aims at its part of what the big ones leave open. All are placed largest first where the
    label distributions of the splits come closest to the goal. Shares are of the distinct record ids.

    More than most_strata strata are an error: the driver holds a number for each.
    Defined results: a record whose copies differ in stratum counts under the least; null strata are a stratum;
    a group larger than every goal goes where it exceeds least; an empty table gives no row.
    """
    names = list(shares)
    weights = np.array([shares[n] for n in names], float) / sum(shares.values())
    groups = materialize(related_groups(records, record_id, entities), "record-groups")
    strata = records.select(F.col(record_id).alias("record"), F.coalesce(stratum.cast("string"), F.lit("\u0001")).alias("stratum")).groupBy("record").agg(F.min("stratum").alias("stratum"))
    cells = groups.join(strata, "record").groupBy("grp", "stratum").agg(F.count(F.lit(1)).alias("n"))
    by_group = materialize(cells.groupBy("grp").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("stratum", "n"))).alias("hist")), "group-strata")
    totals = {r["stratum"]: r["n"] for r in by_group.select(F.explode("hist").alias("stratum", "n")).groupBy("stratum").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "stratum").limit(most_strata + 1).collect()}
    if len(totals) > most_strata:
        raise ValueError(f"more than {most_strata} strata; merge some or raise most_strata")
    count, all_records = by_group.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not count:
        return groups.select("record", "grp", F.lit(None).cast("string").alias("split"))
    order = list(totals)
    goal = np.outer(weights, [totals[s] for s in order] + [all_records - sum(totals.values())]).astype(float)

    def matrix(hists) -> np.ndarray:
        m = np.zeros((len(hists), len(order) + 1))
        at = {s: i for i, s in enumerate(order)}
        for i, h in enumerate(hists):
            for s, n in (h.items() if isinstance(h, dict) else h):
                m[i, at.get(s, len(order))] += n
        return m

    is_big = F.col("size") * big_one_in >= F.lit(all_records)
    big = by_group.where(is_big).orderBy(F.desc("size"), "grp").collect()  # at most big_one_in rows
    filled = np.zeros_like(goal)
    placed = _greedy(np.array([r["size"] for r in big], float), matrix([r["hist"] for r in big]), goal, filled) if big else []
    tasks = max(1, -(-(count - len(big)) // groups_per_task))
    open_goal = np.maximum(goal - filled, 0.0) / tasks

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "grp"], ascending=[False, True], kind="stable").reset_index(drop=True)
        got = _greedy(pdf["size"].to_numpy(float), matrix(pdf["hist"].tolist()), open_goal, np.zeros_like(open_goal))
        return pd.DataFrame({"grp": pdf["grp"], "split": [names[i] for i in got]})

    small = by_group.where(~is_big).groupBy(F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("task")).applyInPandas(lambda pdf: each(pdf), "grp string, split string")
    done = small
    if big:
        done = small.unionByName(records.sparkSession.createDataFrame([(r["grp"], names[i]) for r, i in zip(big, placed)], "grp string, split string"))
    return salted_join(groups, done, "grp", "inner", hot_keys(by_group.select("grp", F.col("size").alias("n")), "grp"), [F.col("record")]).select("record", "grp", "split")


def label_deviation(assigned: DataFrame, records: DataFrame, record_id: str, stratum: Column, shares: dict[str, float]) -> DataFrame:
    """(split, stratum, n, target, deviation): how far each split's labels are from its share of all, in records and relative to the target.

    assigned: (record, split), see assign_splits. A stratum that a split has no record of is a row with n 0;
    records whose copies differ in stratum count under the least; null strata are a stratum.
    """
    total = sum(shares.values())
    strata = records.select(F.col(record_id).alias("record"), stratum.cast("string").alias("stratum")).groupBy("record").agg(F.min("stratum").alias("stratum"))
    cells = strata.join(assigned.select("record", "split"), "record").groupBy("stratum").agg(*(F.count_if(F.col("split") == s).alias(f"n_{i}") for i, s in enumerate(shares)), F.count(F.lit(1)).alias("all"))
    rows = F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"n_{i}").alias("n"), (F.col("all") * F.lit(x / total)).alias("target")) for i, (s, x) in enumerate(shares.items())))
    return cells.select("stratum", F.explode(rows).alias("x")).select("x.split", "stratum", "x.n", "x.target", ((F.col("x.n") - F.col("x.target")) / F.col("x.target")).alias("deviation"))
