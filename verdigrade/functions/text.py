"""Text as Column expressions; one-line Arrow UDFs only for what Unicode rules the JVM lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms of credentials; the first group stays.
SECRETS = (
    r"(?i)(authorization\s*[:=]\s*)(?:bearer\s+)?[^\s,;]+",
    r"(?i)((?:api[_-]?key|token|password|secret)\s*[:=]\s*)[^\s,;]+",
    r"(?i)([?&](?:api[_-]?key|token|key)=)[^&\s]+",
)
# Abbreviations whose point ends no sentence, and words dropped before comparison.
ABBREVIATIONS = ("e.g.", "i.e.", "vs.", "etc.", "Dr.", "Mr.", "Ms.", "Fig.", "No.")
ARTICLES = ("a", "an", "the")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding; differs from lower() for letters such as ß."""
    return text.map(lambda t: None if t is None else t.casefold())


def strip(c: Column) -> Column:
    """Without outer white space of any kind; SQL's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, limit: int) -> Column:
    """Collapsed to at most `limit` characters; the ellipsis counts."""
    flat = collapse(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(max(limit - 1, 0))), F.lit("…") if limit > 0 else F.lit("")))


def redact(c: Column, limit: int = 240) -> Column:
    """Credentials replaced, on one line, at most `limit` characters."""
    out = collapse(c)
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "$1[REDACTED]")
    return truncate(out, limit)


def tokens(c: Column) -> Column:
    """Words of Unicode letters, digits and underscores in lower case; null stays null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def normalized(c: Column, lowercase: bool = True, punctuation: bool = True, articles: bool = True, collapse_space: bool = True, unicode: bool = True, tolerance: float | None = None) -> Column:
    """The comparison form of a text: compatibility forms, lower case, no punctuation but . and -, rounded numbers, no articles."""
    out = nfkc(c) if unicode else c
    out = F.lower(out) if lowercase else out
    out = F.regexp_replace(out, r"(?U)[^\w\s.-]", " ") if punctuation else out
    if tolerance is not None:
        out = rounded_numbers(tolerance)(out)
    if articles:
        words = F.filter(F.split(collapse(out), " "), lambda w: ~w.isin(*ARTICLES))
        out = F.array_join(words, " ")
    return collapse(out) if collapse_space else out


def rounded_numbers(tolerance: float):
    """A UDF that writes each number as its nearest multiple of tolerance (0: as it is)."""

    @F.pandas_udf(T.StringType())
    def each(text: pd.Series) -> pd.Series:
        def one(m) -> str:
            x = float(m.group())
            x = round(x / tolerance) * tolerance if tolerance else x
            return str(int(x)) if x == int(x) else str(x)

        return text.str.replace(r"-?\d+\.?\d*", one, regex=True)

    return each


def without_fence(c: Column) -> Column:
    """What a Markdown fence around the whole text holds; other texts as they are, stripped."""
    flat = strip(c)
    inner = F.regexp_extract(flat, r"(?s)^```[A-Za-z0-9_-]*\s*\n(.*?)\n?\s*```$", 1)
    return F.when(flat.rlike(r"(?s)^```[A-Za-z0-9_-]*\s*\n.*```$"), strip(inner)).otherwise(flat)


def claims(c: Column, most: int = 20, limit: int = 280) -> Column:
    """Sentences of each line, at most `most`, each truncated; a point that ends an abbreviation ends no sentence."""
    abbreviated = "|".join("".join(f"\\{x}" if not x.isalnum() else x for x in a) for a in ABBREVIATIONS)
    parts = F.split(c, rf"(?U)(?<=[.!?])(?<!{abbreviated})\s+|[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
    return F.slice(F.filter(F.transform(parts, lambda p: truncate(p, limit)), lambda p: p != ""), 1, most)


def outcome(output: Column, finish_reason: Column, timed_out: Column, failed: Column) -> Column:
    """What became of a generation, by the first rule that holds."""
    return (
        F.when(timed_out, "harness_timeout")
        .when(failed, "harness_error")
        .when(F.coalesce(strip(output), F.lit("")) == "", "empty_output")
        .when(finish_reason == "length", "truncated")
        .when(finish_reason == "content_filter", "content_filtered")
        .when(F.lower(strip(output)).rlike(r"^(i can't|i cannot)"), "refused")
        .otherwise("passed")
    )


def prompt_key(inputs: Column) -> Column:
    """A comparable form of the inputs map: keys sorted, values trimmed in lower case."""
    entries = F.array_sort(F.map_entries(inputs))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], F.lower(F.btrim(F.coalesce(e["value"], F.lit("")))))), "|")


def token_estimate(c: Column, budget: int = 512) -> Column:
    """Tokens a request is charged for in advance: a third of its characters, rounded up, plus the answer's budget."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 2) / 3)) + F.lit(budget)


def rendered(template: str, inputs: Column) -> Column:
    """A prompt template with {{ name }} slots filled from a map of strings; a name that is missing leaves nothing."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(?:inputs\.)?([A-Za-z_]\w*)\s*\}\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.element_at(inputs, F.lit(m.group(1))), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def shown_inputs(inputs: Column) -> Column:
    """A case's inputs for a reader: a single value as it is, several as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(inputs)))
    return F.when(F.size(inputs) == 1, F.map_values(inputs)[0]).otherwise(F.to_json(ordered))


def shown_reference(answer: Column, label: Column, as_json: Column, references: Column) -> Column:
    """What a case expects, for a reader: the answer, else the label, the JSON or the references in a row."""
    joined = F.nullif(F.array_join(F.coalesce(references, F.array().cast("array<string>")), "; "), F.lit(""))
    return F.coalesce(F.nullif(answer, F.lit("")), label, as_json, joined)
