"""Orphan references: keys that point to records which do not exist, no longer or not yet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.functions.keys import norm_key
from verdigrade.operators.skew import hot_keys, salted_join


#: Why a reference does not hold; of several reasons at one time the first counts.
REASONS = ("missing", "late", "deleted")


@dataclass(frozen=True)
class Reference:
    """A column of a child table that names records of a parent table."""

    child: str
    ref_id: str
    ref_key: str
    made_at: str
    parent: str
    parent_key: str


def reference_rows(children: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(ref_table, ref_key, parent, ref_id, row, k, t): every non-blank reference of every child table.

    Ids keep their type; where the child tables' ids differ in type all are strings. row: numbers the rows
    without an id, which are no copies of one another, as they are read; null for all others.
    """
    types = {children[r.child].schema[r.ref_id].dataType.simpleString() for r in references}
    out = None
    for r in references:
        ref_id = F.col(r.ref_id)
        rows = children[r.child].select(
            F.lit(r.child).alias("ref_table"),
            F.lit(r.ref_key).alias("ref_key"),
            F.lit(r.parent).alias("parent"),
            (ref_id if len(types) == 1 else ref_id.cast("string")).alias("ref_id"),
            F.when(ref_id.isNull(), F.monotonically_increasing_id()).alias("row"),
            norm_key(F.col(r.ref_key)).alias("k"),
            F.col(r.made_at).alias("t"),
        ).where(F.col("k").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def parent_spans(parents: dict[str, DataFrame], references: Sequence[Reference], loaded_at: str = "loaded_at", deleted_at: str = "deleted_at") -> DataFrame:
    """(parent, k, born, gone): when each key first arrived and when it was first deleted."""
    out = None
    for name, key in sorted({(r.parent, r.parent_key) for r in references}):
        rows = parents[name].select(
            F.lit(name).alias("parent"),
            norm_key(F.col(key)).alias("k"),
            F.col(loaded_at).alias("born"),
            F.col(deleted_at).alias("gone"),
        ).where(F.col("k").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("parent", "k").agg(F.min("born").alias("born"), F.min("gone").alias("gone"))


_ID = ("ref_table", "ref_key", "ref_id", "row")


def judged_references(children: dict[str, DataFrame], parents: dict[str, DataFrame], references: Sequence[Reference], keep_sound: bool) -> DataFrame:
    """(ref_table, ref_key, ref_id, row, t, orphan): the references once an id; orphan is null where the reference holds.

    t: the earliest time of the reference's copies; orphan: struct of the earliest copy that does not hold.
    keep_sound: whether references come out that hold.
    """
    refs = reference_rows(children, references)
    spans = parent_spans(parents, references)
    keys = (
        refs.groupBy("parent", "k")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
        .withColumn("pk", F.struct("parent", "k"))
    )
    held = spans.select("parent", F.col("k").alias("held_k"), F.col("born").alias("b"), F.col("gone").alias("g")).withColumnRenamed("parent", "held_parent")
    suspects = keys.join(
        held,
        (F.col("parent") == F.col("held_parent"))
        & (F.col("k") == F.col("held_k"))
        & (F.col("b").isNull() | (F.col("b") <= F.col("first")))
        & (F.col("g").isNull() | (F.col("g") > F.col("last"))),
        "left_anti",
    )
    suspects = suspects.join(spans.withColumn("found", F.lit(True)), ["parent", "k"], "left").select("pk", F.lit(True).alias("suspect"), "found", "born", "gone")
    rows = salted_join(refs.withColumn("pk", F.struct("parent", "k")), suspects, "pk", "left" if keep_sound else "inner", hot_keys(keys, "pk"), [F.col(c) for c in _ID])
    reason = F.when(
        F.col("suspect"),
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("born") > F.col("t"), "late")
        .when(F.col("gone") <= F.col("t"), "deleted"),
    )
    rank = F.array_position(F.array(*(F.lit(r) for r in REASONS)), F.col("reason"))
    first = F.struct(F.col("t").isNull().alias("undated"), F.col("t").alias("t"), rank.alias("rank"), F.col("k").alias("k"), F.col("reason").alias("reason"))
    return rows.withColumn("reason", reason).groupBy(*_ID).agg(F.min("t").alias("t"), F.min(F.when(F.col("reason").isNotNull(), first)).alias("orphan"))


def orphan_references(children: dict[str, DataFrame], parents: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(ref_table, ref_key, ref_id, k, t, reason): each reference that does not hold at its time t, once an id.

    The distinct foreign keys, with their counts and earliest and latest times, go into a left anti-join
    against the parent keys that exist over all of that time; what is left are the suspect keys, and only
    they are joined back to the references, where each row's own time decides. A key under which a large
    share of the references falls costs one row before the join back, and there its rows are salted.

    reason: missing (no row has the key), late (the first row arrives after t) or deleted (at or before t).
    Defined results: null and blank keys refer to nothing and never come out; a null t is an orphan only if
    the key is missing; null arrival times are passed over, and a parent with only such times exists from
    the start. Copies of a reference come out once; with differing copies it is an orphan if one is, and
    k, t and reason are those of one copy: the earliest orphan (a null t comes last), of equal times the
    first in REASONS, then the least key. Rows without an id are each a reference of their own; ids may have
    any type. Empty tables give no rows, or every reference as missing; further columns are not read.
    """
    rows = judged_references(children, parents, references, False)
    return rows.where(F.col("orphan").isNotNull()).select("ref_table", "ref_key", "ref_id", "orphan.k", "orphan.t", "orphan.reason")


def orphan_report(children: dict[str, DataFrame], parents: dict[str, DataFrame], references: Sequence[Reference], period: str = "yyyy-MM") -> DataFrame:
    """(ref_table, ref_key, period, n_references, n_orphans, n_missing, n_late, n_deleted), references counted once an id.

    One aggregate counts references and orphans. period: a format of the reference's earliest time; a null
    time falls into the period null.
    """
    reason = F.col("orphan.reason")
    return (
        judged_references(children, parents, references, True)
        .groupBy("ref_table", "ref_key", F.date_format("t", period).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("n_references"),
            F.count("orphan").alias("n_orphans"),
            *(F.count_if(reason == r).alias(f"n_{r}") for r in REASONS),
        )
    )
