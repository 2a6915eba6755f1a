"""Pinned values of the statistics and of their distributed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigrade.functions import stats
from verdigrade.operators import calibration as cal
from verdigrade.operators import compare as cmp
from verdigrade.operators.ordered import running


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_wilson(spark):
    lo, hi = stats.wilson(F.lit(1), F.lit(1))
    a, b = stats.wilson(F.lit(50), F.lit(100))
    z, y = stats.wilson(F.lit(0), F.lit(0))
    r = one(spark, lo, hi, a, b, z, y)
    assert r[0] == pytest.approx(0.20654931437723745, abs=1e-12) and r[1] == 1.0
    assert r[2] == pytest.approx(0.4038315303659956, abs=1e-12) and r[3] == pytest.approx(0.5961684696340044, abs=1e-12)
    assert (r[4], r[5]) == (0.0, 0.0)


@pytest.mark.parametrize("b,c", [(1, 1), (2, 7), (0, 5), (10, 40), (0, 0), (300, 340)])
def test_mcnemar(spark, b, c):
    n = b + c
    exact = 1.0 if b == c else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert one(spark, stats.mcnemar(F.lit(b), F.lit(c)))[0] == pytest.approx(exact, rel=1e-9)


def test_pass_at_k(spark):
    r = one(spark, stats.pass_at_k(F.lit(10), F.lit(2), 3), stats.pass_at_k(F.lit(3), F.lit(2), 2), stats.pass_at_k(F.lit(3), F.lit(4), 1))
    assert r[0] == pytest.approx(0.5333333333333333) and r[1] == 1.0 and r[2] is None


def test_sample_size_and_hypotheses():
    assert stats.benjamini_hochberg([0.001, 0.02, 0.5]) == [True, True, False]
    assert stats.benjamini_hochberg([]) == []
    assert stats.required_sample_size(0.5, 0.1) == math.ceil(2 * ((1.959963984540054 + 0.8416212335729143) / (2 * (math.asin(math.sqrt(0.6)) - math.asin(math.sqrt(0.5))))) ** 2)
    with pytest.raises(ValueError):
        stats.required_sample_size(0.5, 0.0)


def test_bootstrap():
    assert stats.bca_bootstrap([]) == (0.0, 0.0) and stats.bca_bootstrap([2.0]) == (2.0, 2.0) and stats.bca_bootstrap([3.0] * 9) == (3.0, 3.0)
    x = np.random.default_rng(1).normal(5, 2, 400)
    lo, hi = stats.bca_bootstrap(x.tolist())
    half = 1.96 * x.std(ddof=1) / 20
    assert abs(lo - (x.mean() - half)) < 0.05 and abs(hi - (x.mean() + half)) < 0.05
    v = [0] * 70 + [1] * 30
    a, b = stats.bca_bootstrap(v), cmp.bca_counts({0: 70, 1: 30}, 10_000, 0)
    assert abs(a[0] - b[0]) < 0.02 and abs(a[1] - b[1]) < 0.02
    with pytest.raises(ValueError):
        stats.paired_bootstrap([1.0], [1.0, 2.0])


def test_hypotheses_over_rows(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    got = {r.i: r.rejected for r in cmp.benjamini_hochberg(df, q=0.05).collect()}
    assert [got[i] for i in range(len(p))] == stats.benjamini_hochberg(p)
    assert cmp.benjamini_hochberg(df.limit(0)).count() == 0


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(float(x), rng.randrange(9)) for x in rng.sample(range(-5000, 5000), 300)] + [(float("nan"), 5), (None, 7)]
    df = spark.createDataFrame(rows, "x double, n long")
    for down in (False, True):
        got = {r.x: r.run_n for r in running(df, "x", ["n"], descending=down, buckets=7).collect() if r.x == r.x}
        order = sorted((r for r in rows if r[0] is not None), key=lambda r: (math.inf if r[0] != r[0] else r[0]), reverse=down)
        total, want = 0, {}
        for x, n in order:
            total += n
            want[x] = total
        assert got == {k: v for k, v in want.items() if k == k}
    assert running(df.limit(0), "x", ["n"]).count() == 0


def test_calibration_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.random() < c, round(c, 2)) for c in (rng.random() for _ in range(500))]
    df = spark.createDataFrame(rows, "correct boolean, confidence double")
    pos, neg = [c for k, c in rows if k], [c for k, c in rows if not k]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert cal.roc_auc(df, "correct", "confidence").first()[0] == pytest.approx(auc)
    assert cal.brier_nll(df, "correct", "confidence").first()[0] == pytest.approx(sum((c - k) ** 2 for k, c in rows) / 500)
    t = cal.best_threshold(df, "correct", "confidence").first()
    f1 = lambda th: 2 * sum(c >= th for c in pos) / (sum(c >= th for _, c in rows) + len(pos))
    assert t.f1 == pytest.approx(max(f1(c) for _, c in rows))
    bins = cal.reliability(df, "correct", "confidence").collect()
    assert sorted((b.n for b in bins), reverse=True) == [34] * 5 + [33] * 10
    only = df.where("correct")
    assert cal.roc_auc(only, "correct", "confidence").first()[0] is None and cal.best_threshold(only, "correct", "confidence").count() == 0


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 2), (1, 2)], "a int, b int")
    t = cal.rating_table(df, "a", "b")
    assert cal.krippendorff(t, True).first()[0] == pytest.approx(1 - 0.4 / np.mean([(x - y) ** 2 for x in [1, 2, 3, 3, 1, 1, 2, 3, 2, 2] for y in [1, 2, 3, 3, 1, 1, 2, 3, 2, 2]]))
    same = cal.rating_table(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b")
    assert cal.cohen_kappa(same).first()[0] is None and cal.spearman(same).first()[0] is None and cal.krippendorff(same, False).first()[0] is None


def test_one_confidence_shared_by_a_billion_rows(spark):
    """A confidence costs one row whatever its count; the closed form equals the sum."""
    for n0, n, e0, miss in ((0, 7, 0, 3), (5, 12, 2, 12), (100, 1000, 40, 1), (0, 1, 0, 1)):
        df = spark.createDataFrame([(n0, n)], "a bigint, b bigint").select((cal.harmonic(F.col("a") + F.col("b")) - cal.harmonic(F.col("a"))).alias("h"))
        assert df.first()[0] == pytest.approx(sum(1 / i for i in range(n0 + 1, n0 + n + 1)), rel=1e-10)
    rows = spark.range(1_000_000).select((F.col("id") % 4 == 0).alias("ok"), F.lit(0.7).alias("p"))
    r = cal.risk_summary(rows, "ok", "p").first()
    assert r.aurc == pytest.approx(0.75, abs=1e-5) and r.accuracy_at == pytest.approx(0.25)


def test_interval_of_many_distinct_values(spark):
    rows = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("x"), F.lit(1).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (float("nan"), 1)], "x double, y int"))
    r = cmp.interval(rows, "x", resamples=2000).first()
    v = np.array([a.x for a in rows.collect() if a.x is not None and a.x == a.x])
    half = 1.96 * v.std() / np.sqrt(len(v))
    assert r["mean"] == pytest.approx(v.mean()) and r.ci_low == pytest.approx(v.mean() - half, abs=half / 8) and r.ci_high == pytest.approx(v.mean() + half, abs=half / 8)
    one = cmp.interval(spark.range(1_000_000).select(F.lit(0.5).alias("x")), "x").first()
    assert (one["mean"], one.ci_low, one.ci_high) == (0.5, 0.5, 0.5)
