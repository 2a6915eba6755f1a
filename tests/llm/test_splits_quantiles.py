"""Groups against a union-find, splits against their shares, sketches against exact ranks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdigrade.functions.keys import norm_key
from verdigrade.llm import quantiles as qt
from verdigrade.llm import splits as sp

RNG = random.Random(4)


def groups_of(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, c, s in rows:
        for e in (("c", c.strip().lower()) if c and c.strip() else None, ("s", s) if s is not None else None):
            if e:
                parent[find(("r", r))] = find(e)
    out = {}
    for r, _, _ in rows:
        out.setdefault(find(("r", r)), set()).add(r)
    return {frozenset(v) for v in out.values()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, RNG.choice(["dev", "HOLDOUT ", None]), 1) for r in rows], "record long, case_id string, set_id string, split string, entity int")



def entities():
    return {"case": norm_key(F.col("case_id")), "set": F.col("set_id")}


CHAIN = [(i, f"c{(i + 1) // 2}", f"s{i // 2}") for i in range(300)]  # one chain through all records
HUB = [(i, f"c{i}", "hub" if i % 3 else None) for i in range(300)]
RANDOM = [(i, RNG.choice([None, "", f" C{RNG.randrange(60)} "]), RNG.choice([None, f"s{RNG.randrange(60)}"])) for i in range(150)] + [(3, "c1", "s1"), (3, "C1\t", "s1")]


@pytest.mark.parametrize("rows", [CHAIN, HUB, RANDOM, [(1, None, None)], []], ids=["chain", "hub", "random", "alone", "empty"])
def test_groups(spark, rows):
    got = {}
    for r in sp.related_groups(frame(spark, rows), "record", entities()).collect():
        got.setdefault(r.grp, []).append(r.record)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {frozenset(v) for v in got.values()} == groups_of(rows)


def test_torn(spark):
    rows = [(1, "a", None, "dev"), (2, "A ", "s", None), (3, None, "s", " Holdout"), (4, "b", None, "dev"), (5, "b", None, "DEV"), (6, None, None, "dev"), (6, None, None, "holdout"), (7, None, None, "dev")]
    df = spark.createDataFrame(rows, "record long, case_id string, set_id string, split string")
    assert {r.record for r in sp.torn_groups(df, "record", entities(), "split").collect()} == {1, 2, 3, 6}


def test_assignment(spark):
    rows = [(i, f"c{i // RNG.choice((1, 2, 3))}", "big" if i % 20 == 0 else None, RNG.choice("abbccc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "record long, case_id string, set_id string, y string")
    got = sp.assign_splits(df, "record", entities(), F.col("y"), {"train": 0.8, "validation": 0.1, "test": 0.1}, groups_per_task=400).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        by.setdefault(r.grp, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    n = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 1600) < 30 and abs(n["validation"] - 200) < 20 and abs(n["test"] - 200) < 20
    y = {r[0]: r[3] for r in rows}
    for c in "abc":
        total = sum(v == c for v in y.values())
        assert abs(sum(y[r.record] == c and r.split == "train" for r in got) / total - 0.8) < 0.03
    assert sp.assign_splits(df.limit(0), "record", entities(), F.col("y"), {"a": 1.0}).count() == 0


def test_percentiles(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, float(int(RNG.expovariate(1 / 300))) if i % 3 else 30000.0, RNG.choice(["qa", None]), t + dt.timedelta(days=RNG.randrange(4))) for i in range(20_000)]
    rows += [rows[7], rows[8], (90_000, None, "qa", t), (90_001, float("nan"), "qa", t), (90_002, -1.0, "qa", t), (90_003, 0.0, "zero", t), (90_004, None, "none", t)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, ms double, task string, at timestamp, sketch int").repartition(5)
    lat = qt.latencies(df, "id", "ms", "task", "at")
    daily = qt.sketches(lat, ["grp", "period"])
    total = qt.percentiles(qt.merge(daily, ["grp"]), ["grp"])
    got = {r.grp: r for r in total.collect()}
    assert set(got) == {"qa", None, "zero"} and got["zero"].p99 == 0.0 and got["qa"].n + got[None].n == 20_000
    assert all(r.within for r in qt.ranks_within(lat, total, ["grp"]).collect())
    for g in ("qa", None):
        x = sorted(r[1] for r in {q[0]: q for q in rows}.values() if r[2] == g and r[1] is not None and r[1] >= 0)
        for q, v in ((0.5, got[g].p50), (0.9, got[g].p90), (0.99, got[g].p99)):
            lo, hi = (sum(y < v for y in x) / len(x), sum(y <= v for y in x) / len(x))
            assert lo - qt.rank_error() <= q <= hi + qt.rank_error()
    assert qt.percentiles(qt.sketches(lat.limit(0), ["grp"]), ["grp"]).count() == 0


def test_every_stratum_counts(spark):
    df = spark.range(40).selectExpr("id as r", "cast(id % 20 as string) as stratum", "concat('e', id) as e")
    with pytest.raises(ValueError):
        sp.assign_splits(df, "r", {"e": F.col("e")}, F.col("stratum"), {"train": 0.5, "test": 0.5}, most_strata=19)
    assert sp.assign_splits(df, "r", {"e": F.col("e")}, F.col("stratum"), {"train": 0.5, "test": 0.5}, most_strata=20).count() == 40
