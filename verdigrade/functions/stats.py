"""Statistics: closed forms as Columns, resampling with numpy over one group's values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)


def _f(x: float) -> Column:
    return F.lit(float(x))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a share, within [0, 1]; (0, 0) without observations."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    s, n = successes.cast("double"), n.cast("double")
    p = F.try_divide(s, n)
    d = 1 + F.try_divide(_f(z * z), n)
    mid = (p + F.try_divide(_f(z * z / 2), n)) / d
    half = _f(z) * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(_f(z * z / 4), n), n)) / d
    none = (n <= 0) | n.isNull()
    return F.when(none, _f(0)).otherwise(F.greatest(_f(0), mid - half)), F.when(none, _f(0)).otherwise(F.least(_f(1), mid + half))


def cohens_h(baseline: Column, candidate: Column) -> Column:
    return 2 * (F.asin(F.sqrt(candidate)) - F.asin(F.sqrt(baseline)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 without any.

    The binomial tail is summed in logarithms: each term follows from the one before.
    """
    n, k = (b + c).cast("double"), F.least(b, c)
    start = F.struct((-n * F.lit(math.log(2))).alias("term"), F.exp(-n * F.lit(math.log(2))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["sum"])
    return F.when(b == c, _f(1)).otherwise(F.least(_f(1), 2 * tail))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k of n tries, c of them right, hold a right one; null where c or k is impossible."""
    ratio = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), _f(1), lambda a, i: a * F.try_divide((n - c - i).cast("double"), (n - i).cast("double")))
    return F.when((c < 0) | (c > n) | F.lit(k < 1), None).when(n - c < k, _f(1)).otherwise(1 - ratio)


def required_sample_size(rate: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Observations an arm needs to tell rate + effect from rate."""
    clamp = lambda p: min(max(p, 1e-9), 1 - 1e-9)
    h = 2 * (math.asin(math.sqrt(clamp(rate + effect))) - math.asin(math.sqrt(clamp(rate))))
    if h == 0:
        raise ValueError("the effect must not be zero")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil(2 * (z / h) ** 2)


def benjamini_hochberg(p: Sequence[float], q: float = 0.05) -> list[bool]:
    """Which of a few hypotheses fall at false discovery rate q; operators.compare has it over rows."""
    order = np.argsort(np.asarray(p, float), kind="stable")
    holds = np.asarray(p, float)[order] <= q * np.arange(1, len(p) + 1) / max(1, len(p))
    cut = np.flatnonzero(holds)
    out = np.zeros(len(p), bool)
    if len(cut):
        out[order[: cut[-1] + 1]] = True
    return out.tolist()


def bca_bootstrap(values: Sequence[float], statistic: Callable = np.mean, resamples: int = 10_000, seed: int = 0, confidence: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval; of fewer than two values or equal ones it has no width.

    Resamples are drawn in blocks, so memory stays at a few million numbers however many values there are.
    """
    x = np.asarray(values, float)
    if x.size < 2 or np.all(x == x[0]):
        v = float(statistic(x)) if x.size else 0.0
        return v, v
    rng, n = np.random.default_rng(seed), x.size
    block = max(1, 4_000_000 // n)
    draws = np.concatenate([np.apply_along_axis(statistic, 1, x[rng.integers(0, n, (min(block, resamples - i), n))]) if statistic is not np.mean else x[rng.integers(0, n, (min(block, resamples - i), n))].mean(1) for i in range(0, resamples, block)])
    seen = float(statistic(x))
    share = (np.count_nonzero(draws < seen) + np.count_nonzero(draws <= seen)) / (2 * len(draws))
    z0 = NormalDist().inv_cdf(min(max(share, 1e-12), 1 - 1e-12))
    left = (x.sum() - x) / (n - 1) if statistic is np.mean else np.array([statistic(np.delete(x, i)) for i in range(n)])
    u = left.mean() - left
    a = float((u**3).sum() / (6 * (u**2).sum() ** 1.5)) if (u**2).sum() > 0 else 0.0
    at = []
    for z in (NormalDist().inv_cdf((1 - confidence) / 2), NormalDist().inv_cdf(1 - (1 - confidence) / 2)):
        w = z0 + z
        at.append(NormalDist().cdf(z0 + w / (1 - a * w)))
    lo, hi = np.quantile(draws, at)
    return float(lo), float(hi)


def paired_bootstrap(baseline: Sequence[float], candidate: Sequence[float], resamples: int = 10_000, seed: int = 0) -> tuple[float, tuple[float, float]]:
    a, b = np.asarray(baseline, float), np.asarray(candidate, float)
    if a.shape != b.shape:
        raise ValueError("paired samples differ in shape")
    return float((b - a).mean()) if a.size else 0.0, bca_bootstrap((b - a).tolist(), resamples=resamples, seed=seed)
