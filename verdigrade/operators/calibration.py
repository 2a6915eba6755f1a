"""Whether confidences mean what they say, and whether two raters agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.ordered import running

CLIP = 1e-12


def harmonic(k: Column) -> Column:
    """1 + 1/2 + ... + 1/k less a constant, to 12 digits, at a cost that doesn't depend on k."""
    shift = 12
    x = k.cast("double") + shift
    far = F.log(x) + 1 / (2 * x) - 1 / (12 * F.pow(x, 2)) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6)) + 1 / (240 * F.pow(x, 8))
    return far - sum((1 / (k + j) for j in range(2, shift + 1)), 1 / (k + 1))


def _by_confidence(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(p, n, hits): rows by distinct confidence, clipped away from 0 and 1."""
    p = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.col(confidence).cast("double")))
    return rows.where(F.col(correct).isNotNull() & F.col(confidence).isNotNull()).groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("hits"))


def reliability(rows: DataFrame, correct: str, confidence: str, bins: int = 15) -> DataFrame:
    """(bin, n, accuracy, confidence): bins of equal numbers of rows by rising confidence, the first ones larger by one.

    Rows of one confidence that fall into several bins are dealt to them in proportion, so no order among
    ties is needed and a confidence that a third of the rows share is one row here.
    """
    g = running(_by_confidence(rows, correct, confidence), "p", ["n"])
    total = g.agg(F.sum("n").alias("all"))
    g = g.crossJoin(F.broadcast(total))
    k = F.least(F.lit(bins), F.col("all")).cast("bigint")
    size, extra = F.floor(F.col("all") / k), F.col("all") % k
    start = F.col("run_n") - F.col("n")
    bin_of = lambda r: F.when(r < extra * (size + 1), F.floor(r / (size + 1))).otherwise(extra + F.floor((r - extra * (size + 1)) / size))
    begin = lambda b: F.when(b <= extra, b * (size + 1)).otherwise(extra * (size + 1) + (b - extra) * size)
    spread = g.withColumn("bin", F.explode(F.sequence(bin_of(start), bin_of(F.col("run_n") - 1))))
    share = F.least(F.col("run_n"), begin(F.col("bin") + 1)) - F.greatest(start, begin(F.col("bin")))
    parts = spread.select("bin", share.alias("m"), (share * F.col("hits") / F.col("n")).alias("h"), (share * F.col("p")).alias("pp"))
    return parts.groupBy("bin").agg(F.sum("m").alias("n"), (F.sum("h") / F.sum("m")).alias("accuracy"), (F.sum("pp") / F.sum("m")).alias("confidence"))


def adaptive_ece(rows: DataFrame, correct: str, confidence: str, bins: int = 15) -> DataFrame:
    """(adaptive_ece): gap between accuracy and confidence, averaged over the bins' rows."""
    r = reliability(rows, correct, confidence, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("adaptive_ece"))


def brier_nll(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    g = _by_confidence(rows, correct, confidence)
    miss, p = F.col("n") - F.col("hits"), F.col("p")
    return g.agg(
        F.try_divide(F.sum(F.col("hits") * (1 - p) * (1 - p) + miss * p * p), F.sum("n")).alias("brier"),
        F.try_divide(-F.sum(F.col("hits") * F.log(p) + miss * F.log(1 - p)), F.sum("n")).alias("nll"),
    )


def risk_coverage(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(p, coverage, risk): share of rows at or above each confidence and the errors among them."""
    g = running(_by_confidence(rows, correct, confidence), "p", ["n", "hits"], descending=True)
    total = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("p", "n", (F.col("run_n") / F.col("all")).alias("coverage"), (1 - F.col("run_hits") / F.col("run_n")).alias("risk"))


def roc_auc(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(roc_auc): chance that a right row outranks a wrong one, ties half; null with one class only."""
    g = running(_by_confidence(rows, correct, confidence).withColumn("miss", F.col("n") - F.col("hits")), "p", ["miss"])
    below = F.col("run_miss") - F.col("miss")
    return g.agg(F.try_divide(F.sum(F.col("hits") * (below + F.col("miss") / 2.0)), F.sum("hits") * F.sum("miss").cast("double")).alias("roc_auc"))


def pr_auc(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(pr_auc): average precision over the distinct confidences; null without a right row."""
    g = running(_by_confidence(rows, correct, confidence), "p", ["n", "hits"], descending=True)
    return g.agg(F.try_divide(F.sum(F.col("hits") * F.col("run_hits") / F.col("run_n")), F.sum("hits").cast("double")).alias("pr_auc"))


def best_threshold(rows: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(threshold, f1): the confidence at which F1 is highest, the lowest of several; no row with one class only."""
    g = running(_by_confidence(rows, correct, confidence), "p", ["n", "hits"], descending=True)
    total = g.agg(F.sum("hits").alias("pos"), F.sum("n").alias("all"))
    f1 = 2.0 * F.col("run_hits") / (F.col("run_n") + F.col("pos"))
    return g.crossJoin(F.broadcast(total)).where("pos > 0 and pos < all").select(F.col("p").alias("threshold"), f1.alias("f1")).orderBy(F.round("f1", 12).desc(), "threshold").limit(1)


def risk_summary(rows: DataFrame, correct: str, confidence: str, at: float = 0.8) -> DataFrame:
    """(aurc, accuracy_at): area under risk by coverage with rows taken in turn, rows of one confidence by their mean risk; accuracy of the first share `at`.

    Within a confidence the errors are spread evenly, which is the mean over all orders of its rows. Its risks
    then sum up to a difference of harmonic numbers, so a confidence that all rows share costs as much as any.
    """
    g = running(_by_confidence(rows, correct, confidence).withColumn("miss", F.col("n") - F.col("hits")), "p", ["n", "miss"], descending=True)
    total = g.agg(F.sum("n").alias("all"))
    g = g.crossJoin(F.broadcast(total))
    n0, e0 = F.col("run_n") - F.col("n"), F.col("run_miss") - F.col("miss")
    risk = lambda i: (e0 + F.col("miss") * i / F.col("n")) / (n0 + i)
    rate = F.col("miss") / F.col("n")
    inner = F.col("miss") + (e0 - rate * n0) * (harmonic(F.col("run_n")) - harmonic(n0))
    ends = F.when(n0 == 0, risk(F.lit(1))).otherwise(0.0) + F.when(F.col("run_n") == F.col("all"), risk(F.col("n"))).otherwise(0.0)
    need = F.greatest(F.lit(1), F.ceil(F.lit(at) * F.col("all")))
    here = F.when((n0 < need) & (F.col("run_n") >= need), 1 - risk(need - n0))
    return g.agg(F.try_divide(F.sum(inner) - F.sum(ends) / 2, F.max("all").cast("double")).alias("aurc"), F.max(here).alias("accuracy_at"))


# Agreement of two raters, from the table of their pairs.


def rating_table(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(t: DataFrame) -> DataFrame:
    """(kappa): null with fewer than two categories."""
    left, right = t.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("x")), t.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    m = left.join(right, "c", "full").na.fill(0, ["x", "y"]).agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("xy"), F.sum("x").cast("double").alias("n"), F.count(F.lit(1)).alias("k"))
    o = t.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return m.crossJoin(o).select(F.when(F.col("k") >= 2, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def spearman(t: DataFrame) -> DataFrame:
    """(rho): correlation of average ranks; null if a rater is constant. t: rating_table of numbers."""
    ranks = None
    for c in ("a", "b"):
        g = running(t.groupBy(c).agg(F.sum("n").alias("n")), c, ["n"])
        r = g.select(F.col(c), (F.col("run_n") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
        ranks = (ranks if ranks is not None else t).join(r, c)
    w = F.col("n")
    s = ranks.agg(F.sum(w).alias("w"), F.sum(w * F.col("ra")).alias("x"), F.sum(w * F.col("rb")).alias("y"), F.sum(w * F.col("ra") * F.col("rb")).alias("xy"), F.sum(w * F.col("ra") * F.col("ra")).alias("xx"), F.sum(w * F.col("rb") * F.col("rb")).alias("yy"))
    return s.select(F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt((F.col("w") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("w") * F.col("yy") - F.col("y") * F.col("y")))).alias("rho"))


def krippendorff(t: DataFrame, ordinal: bool) -> DataFrame:
    """(alpha) of two raters; ordinal: squared differences of numbers, else whether they differ. Null with one value only.

    What chance would disagree is had from sums: 2 (E[x²] - E[x]²) for squares, 1 - Σ shares² for categories.
    """
    if ordinal:
        d = F.col("a") - F.col("b")
        s = t.agg(F.sum("n").alias("n"), F.sum(F.col("n") * d * d).alias("o"), F.sum(F.col("n") * (F.col("a") + F.col("b"))).alias("x"), F.sum(F.col("n") * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("xx"))
        m = 2.0 * F.col("n")
        expected = 2 * (F.col("xx") / m - (F.col("x") / m) * (F.col("x") / m))
        return s.select((1 - F.try_divide(F.col("o") / F.col("n"), F.when(expected > 0, expected))).alias("alpha"))
    values = t.select("a", "n").unionByName(t.select(F.col("b").alias("a"), "n")).groupBy("a").agg(F.sum("n").alias("c"))
    e = values.agg(F.sum("c").cast("double").alias("m"), F.sum(F.col("c") * F.col("c")).cast("double").alias("cc"))
    o = t.agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("d"), F.sum("n").cast("double").alias("n"))
    expected = 1 - F.col("cc") / (F.col("m") * F.col("m"))
    return e.crossJoin(o).select((1 - F.try_divide(F.col("d") / F.col("n"), F.when(expected > 0, expected))).alias("alpha"))


