"""Two runs against each other: pairing, flaky cases, exact tests and multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.functions.stats import bca_bootstrap, cohens_h, mcnemar
from verdigrade.operators.ordered import running


def paired(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], passed: str = "passed") -> DataFrame:
    """(keys..., old, new): verdicts of both runs for the same case and repeat; cases without verdict are left out."""
    a = baseline.where(F.col(passed).isNotNull()).select(*keys, F.col(passed).alias("old"))
    b = candidate.where(F.col(passed).isNotNull()).select(*keys, F.col(passed).alias("new"))
    return a.join(b, list(keys))


def flaky(pairs: DataFrame, case: str) -> DataFrame:
    """(case): cases whose repeats disagree in either run."""
    g = pairs.groupBy(case).agg(F.min("old").alias("a"), F.max("old").alias("b"), F.min("new").alias("c"), F.max("new").alias("d"))
    return g.where((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).select(case)


def compare_binary(pairs: DataFrame) -> DataFrame:
    """One row: n, rates, delta, discordant counts, exact McNemar p, Cohen's h and the relative change (null from 0)."""
    a = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("old").cast("double")).alias("baseline_rate"), F.avg(F.col("new").cast("double")).alias("candidate_rate"),
        F.count_if(F.col("old") & ~F.col("new")).alias("only_baseline"), F.count_if(~F.col("old") & F.col("new")).alias("only_candidate"),
    )
    return a.select(
        "*", (F.col("candidate_rate") - F.col("baseline_rate")).alias("delta"), F.try_divide(F.col("candidate_rate") - F.col("baseline_rate"), F.col("baseline_rate")).alias("relative_delta"),
        mcnemar(F.col("only_baseline"), F.col("only_candidate")).alias("p_value"), cohens_h(F.col("baseline_rate"), F.col("candidate_rate")).alias("cohens_h"),
    )


def delta_interval(pairs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(delta, ci_low, ci_high): BCa interval of the mean difference.

    A paired difference of verdicts is -1, 0 or 1, so the sample is its three counts: they alone reach the
    task, and each resample is one multinomial draw however many pairs there are.
    """
    counts = pairs.select((F.col("new").cast("int") - F.col("old").cast("int")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bca_counts(dict(zip(pdf["d"], pdf["n"])), resamples, seed)
        n = pdf["n"].sum()
        return pd.DataFrame({"delta": [float((pdf["d"] * pdf["n"]).sum() / n)], "ci_low": [lo], "ci_high": [hi]})

    return counts.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: each(pdf), "delta double, ci_low double, ci_high double")


#: Values of a sample beyond which they are put into as many bins of equal counts, and draws made at a time.
BINS, DRAWS = 4096, 256


def bca_counts(counts: dict[float, int], resamples: int, seed: int, confidence: float = 0.95, spread: dict[float, float] | None = None, moments: tuple[float, float] | None = None) -> tuple[float, float]:
    """bca_bootstrap of the mean of a sample given as value: count, without spelling the sample out.

    Where values are means of bins, spread is the variance within each and moments are the sums of squares and
    cubes of the whole sample; the sum of the draws from a bin is then normal about its mean.
    """
    import numpy as np
    from statistics import NormalDist

    order = sorted(counts)
    v, c = np.array(order, float), np.array([counts[x] for x in order], float)
    n = c.sum()
    seen = float((v * c).sum() / n)
    if n < 2 or np.count_nonzero(c) < 2:
        return seen, seen
    random, parts = np.random.default_rng(seed), []
    within = np.array([spread[x] for x in order], float) if spread else None
    for start in range(0, resamples, DRAWS):
        drawn = random.multinomial(int(n), c / n, min(DRAWS, resamples - start))
        means = drawn @ v / n
        parts.append(means if within is None else means + random.normal(size=len(means)) * np.sqrt(drawn @ within) / n)
    draws = np.concatenate(parts)
    share = (np.count_nonzero(draws < seen - 1e-15) + np.count_nonzero(draws <= seen + 1e-15)) / (2 * resamples)
    z0 = NormalDist().inv_cdf(min(max(share, 1e-12), 1 - 1e-12))
    if moments:
        two = moments[0] - n * seen**2
        three = moments[1] - 3 * seen * moments[0] + 2 * n * seen**3
    else:
        two, three = (c * (v - seen) ** 2).sum(), (c * (v - seen) ** 3).sum()
    a = float(three / (6 * two**1.5))
    out = []
    for q in ((1 - confidence) / 2, 1 - (1 - confidence) / 2):
        w = z0 + NormalDist().inv_cdf(q)
        out.append(NormalDist().cdf(z0 + w / (1 - a * w)))
    lo, hi = np.quantile(draws, out)
    return float(lo), float(hi)


def interval(values: DataFrame, value: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(mean, ci_low, ci_high) of a metric by BCa over its distinct values and counts; nulls and NaN are left out.

    More than BINS distinct values reach the task as so many bins of equal counts, with what varies within.
    """
    x = F.col(value).cast("double")
    counts = values.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts.withColumn("one", F.lit(1).cast("bigint")), "v", ["n", "one"])
    totals = ranked.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct"))
    place = F.when(F.col("distinct") <= BINS, F.col("run_one")).otherwise(F.floor((F.col("run_n") - F.col("n")) * F.lit(BINS) / F.col("all")))
    sums = [F.sum(F.col("n") * F.pow("v", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3)]
    counts = ranked.crossJoin(F.broadcast(totals)).groupBy(place.alias("bin")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), *sums)  # at most BINS rows

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n, mean = pdf["n"].sum(), float(pdf["s1"].sum() / pdf["n"].sum())
        if len(pdf) == 1 and pdf["m"].iloc[0] == 1:
            lo, hi = bca_bootstrap([mean])
        else:
            v = (pdf["s1"] / pdf["n"]).tolist()
            spread = dict(zip(v, (pdf["s2"] / pdf["n"] - (pdf["s1"] / pdf["n"]) ** 2).clip(lower=0).where(pdf["m"] > 1, 0.0))) if (pdf["m"] > 1).any() else None
            lo, hi = bca_counts(dict(zip(v, pdf["n"])), resamples, seed, spread=spread, moments=(float(pdf["s2"].sum()), float(pdf["s3"].sum())) if spread else None)
        return pd.DataFrame({"mean": [mean], "ci_low": [lo], "ci_high": [hi]})

    return counts.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: each(pdf), "mean double, ci_low double, ci_high double")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", q: float = 0.05) -> DataFrame:
    """tests with `rejected`: all up to the largest rank whose p is within q times its share of the ranks; equal p fare alike."""
    by_p = tests.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("m"))
    ranked = running(by_p, "_p", ["m"])
    total = by_p.agg(F.sum("m").alias("all"))
    cut = ranked.crossJoin(F.broadcast(total)).where(F.col("_p") <= q * F.col("run_m") / F.col("all")).agg(F.max("_p").alias("_cut"))
    return tests.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def between_repeat_variance(scores: DataFrame, case: str, value: str) -> DataFrame:
    """(variance): mean over cases of the sample variance of their repeats; 0 if no case has two."""
    return scores.groupBy(case).agg(F.var_samp(value).alias("v"), F.count(value).alias("n")).where("n > 1").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("variance"))
