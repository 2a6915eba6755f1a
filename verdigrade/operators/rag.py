"""Evidence of retrieval-augmented answers: claims, contexts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrade.functions.text import claims, truncate

CONTEXTS = 20


def claim_rows(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, claim_index, claim): one row a claim of each answer."""
    return answers.select(key, F.posexplode(claims(F.col(text))).alias("claim_index", "claim"))


def bounded_contexts(contexts: Column, limit: int = 280) -> Column:
    """The first contexts, each truncated."""
    return F.transform(F.slice(contexts, 1, CONTEXTS), lambda c: truncate(c, limit))


def context_scores(cases: DataFrame, retrieved: str, relevant: str) -> DataFrame:
    """cases with precision (repeats count) and recall (as a set) of retrieved ids; nothing retrieved or relevant gives 0; null ids without qrels."""
    hits = F.filter(retrieved, lambda d: F.array_contains(relevant, d))
    p = F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size(retrieved).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.size(F.array_intersect(retrieved, relevant)).cast("double"), F.size(F.array_distinct(relevant)).cast("double")), F.lit(0.0))
    known = F.col(relevant).isNotNull()
    return cases.withColumns({"context_precision": F.when(known, p), "context_recall": F.when(known, r)})


def unsupported_rate(entailments: DataFrame, keys: list[str]) -> DataFrame:
    """(n_claims, unsupported_rate) over rows (keys..., label): a claim is supported if any context entails it."""
    per = entailments.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("label") == "entailment"), F.lit(False)).alias("supported"))
    return per.agg(F.count(F.lit(1)).alias("n_claims"), F.avg((~F.col("supported")).cast("double")).alias("unsupported_rate"))


def citation_attribution(citations: DataFrame) -> DataFrame:
    """(n_citations, attribution) over rows (present, relevant, entailed): cited, there, and relevant or entailing; null without citations."""
    ok = F.coalesce("present", F.lit(False)) & (F.coalesce("relevant", F.lit(False)) | F.coalesce("entailed", F.lit(False)))
    return citations.agg(F.count(F.lit(1)).alias("n_citations"), F.avg(ok.cast("double")).alias("attribution"))


def last_label(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One label a key; the one that comes last in `order` counts."""
    return rows.groupBy(*keys).agg(F.max_by("label", order).alias("label"))
