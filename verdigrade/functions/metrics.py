"""Metrics of one output against its case: Columns where the JVM can, Arrow UDFs for n-gram and JSON work.

A metric's value is null where it can't be computed (no reference, no qrels) and never where the output is
merely wrong; rollup and report leave nulls out of n.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigrade.functions.text import normalized, strip

WORD = re.compile(r"\w+")
NUMBER = r"([-+]?\d*\.?\d+)"


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _one(flag: Column) -> Column:
    return flag.cast("double")


def reference(answer: Column, references: Column | None = None) -> Column:
    """The reference answer; an empty one gives way to the first of the references."""
    first = F.try_element_at(references, F.lit(1)) if references is not None else F.lit(None).cast("string")
    return F.coalesce(F.nullif(answer, F.lit("")), first)


def given_reference(answer: Column, references: Column, ref: Column) -> Column:
    """The reference answer as it stands, an empty one too; only a missing one gives way to the first of the references."""
    return F.coalesce(answer, F.try_element_at(references, F.lit(1)), ref)


def exact_match(output: Column, ref: Column) -> Column:
    return _one(normalized(output) == normalized(ref))


@F.pandas_udf(_longs("overlap", "n_output", "n_reference"))
def _shared_words(output: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = []
    for o, r in zip(output, ref):
        a, b = Counter(WORD.findall((o or "").casefold())), Counter(WORD.findall((r or "").casefold()))
        rows.append((sum((a & b).values()), a.total(), b.total()))
    return pd.DataFrame(rows, columns=["overlap", "n_output", "n_reference"])


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def squad_f1(output: Column, ref: Column) -> Column:
    """F1 of the word multisets; two empty texts agree."""
    s = _shared_words(output, ref)
    p = F.when(s["n_output"] > 0, s["overlap"] / s["n_output"]).when(s["n_reference"] == 0, 1.0).otherwise(0.0)
    r = F.when(s["n_reference"] > 0, s["overlap"] / s["n_reference"]).when(s["n_output"] == 0, 1.0).otherwise(0.0)
    return F.when(output.isNotNull() & ref.isNotNull(), _f1(p, r))


def levenshtein_similarity(output: Column, ref: Column) -> Column:
    """One less the edit distance as a share of the longer text; two empty texts are alike."""
    longest = F.greatest(F.length(output), F.length(ref))
    return F.when(output.isNull() | ref.isNull(), None).when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(output, ref) / longest)


def assertions(output: Column, must: Column, must_not: Column) -> Column:
    """1 if all wanted terms and none of the unwanted are in the output, whatever their case; no output fails."""
    low = F.lower(output)
    ok = F.forall(F.coalesce(must, F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t))) & ~F.exists(F.coalesce(must_not, F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t)))
    return F.when(output.isNull(), 0.0).otherwise(_one(ok))


def numeric_assertion(output: Column, ref: Column, rel: float = 1e-6, absolute: float = 1e-6) -> Column:
    """1 if both texts hold the same numbers in the same order, within tolerance."""
    nums = lambda c: F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))
    a, b = nums(output), nums(ref)
    close = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(_one(F.forall(close, lambda x: x)))


def classification(output: Column, label: Column) -> Column:
    return _one(strip(output) == label)


def json_validity(output: Column) -> Column:
    """1 if the output is strict JSON; without output 0."""
    return F.coalesce(_one(F.try_parse_json(output).isNotNull()), F.lit(0.0))


def _fits(value: object, schema: Mapping) -> bool:
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    names = [want] if isinstance(want, str) else want or []

    def is_kind(name: str) -> bool:
        if name == "integer":
            return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
        if name == "number":
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        return isinstance(value, kinds.get(name, object))

    if names and not any(is_kind(n) for n in names):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and set(value) - set(inner):
            return False
        return all(_fits(v, inner[k]) for k, v in value.items() if k in inner)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf) and all(_fits(v, schema.get("items", {})) for v in value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf) and bool(re.search(schema.get("pattern", ""), value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    return True


@F.pandas_udf(T.DoubleType())
def json_schema_validity(output: pd.Series, schema: pd.Series) -> pd.Series:
    """1 if the output is JSON that fits its JSON Schema (types, required, properties, enum, bounds); no schema: JSON at all."""

    def one(o: str | None, s: str | None) -> float:
        try:
            value = json.loads(o or "")
        except ValueError:
            return 0.0
        return float(not s or _fits(value, json.loads(s)))

    return pd.Series([one(o, s) for o, s in zip(output, schema)], dtype=float)


def leaves(value: object) -> dict[str, object]:
    """Leaf values by dotted and indexed path; a scalar has the empty path, empty containers none."""
    out, todo = {}, [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{path}.{k}" if path else k, x) for k, x in v.items())
        elif isinstance(v, list):
            todo.extend((f"{path}[{i}]", x) for i, x in enumerate(v))
        else:
            out[path] = v
    return out


@F.pandas_udf(T.DoubleType())
def json_field_f1(output: pd.Series, expected: pd.Series) -> pd.Series:
    """F1 of the leaf fields; null without expectation, 0 for an output that is no JSON. An expected null holds if the field is absent."""

    def one(o: str | None, e: str | None) -> float | None:
        if e is None:
            return None
        want = leaves(json.loads(e))
        try:
            got = leaves(json.loads(o or ""))
        except ValueError:
            return 0.0
        hits = sum(got.get(k) == v for k, v in want.items())
        return 2 * hits / (len(got) + len(want)) if hits else 0.0

    return pd.Series([one(o, e) for o, e in zip(output, expected)], dtype="Float64").astype(object).where(lambda s: s.notna(), None)


# Rankings: arrays of ids, best first, against a map of graded gains.


def ranking(output: Column) -> Column:
    """The ids of a JSON array of strings or of a comma list, each once, in order; nothing from null."""
    as_json = F.from_json(output, "array<string>")
    as_list = F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), ","), strip), lambda x: x != "")
    return F.array_distinct(F.when(strip(output).startswith("["), F.coalesce(as_json, F.array().cast("array<string>"))).otherwise(as_list))


def relevant(qrels: Column) -> Column:
    return F.map_filter(qrels, lambda _, gain: gain > 0)


def _hits(rank: Column, qrels: Column, k: int | None) -> Column:
    ids = F.map_keys(relevant(qrels))
    return F.filter(F.slice(rank, 1, k) if k else rank, lambda d: F.array_contains(ids, d))


def _if_relevant(qrels: Column, value: Column) -> Column:
    """Null where nothing is relevant, also where all gains are zero."""
    return F.when(F.size(relevant(qrels)) > 0, value)


def precision_at(rank: Column, qrels: Column, k: int = 10) -> Column:
    return _if_relevant(qrels, F.size(_hits(rank, qrels, k)) / F.lit(float(k)))


def recall_at(rank: Column, qrels: Column, k: int = 10) -> Column:
    return _if_relevant(qrels, F.try_divide(F.size(_hits(rank, qrels, k)).cast("double"), F.size(relevant(qrels)).cast("double")))


def hit_at(rank: Column, qrels: Column, k: int = 10) -> Column:
    return _if_relevant(qrels, _one(F.size(_hits(rank, qrels, k)) > 0))


def reciprocal_rank(rank: Column, qrels: Column) -> Column:
    ids = F.map_keys(relevant(qrels))
    places = F.filter(F.transform(rank, lambda d, i: F.when(F.array_contains(ids, d), i + 1)), lambda i: i.isNotNull())
    return _if_relevant(qrels, F.coalesce(1 / F.array_min(places).cast("double"), F.lit(0.0)))


def average_precision(rank: Column, qrels: Column) -> Column:
    ids = F.map_keys(relevant(qrels))
    start = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("seen"))

    def step(a: Column, d: Column) -> Column:
        hit = F.when(F.array_contains(ids, d), 1.0).otherwise(0.0)
        return F.struct((a["hits"] + hit).alias("hits"), (a["sum"] + hit * (a["hits"] + hit) / (a["seen"] + 1)).alias("sum"), (a["seen"] + 1).alias("seen"))

    total = F.aggregate(rank, start, step, lambda a: a["sum"])
    return _if_relevant(qrels, F.try_divide(total, F.size(relevant(qrels)).cast("double")))


def ndcg_at(rank: Column, qrels: Column, k: int = 10) -> Column:
    """Discounted cumulative gain, 2^gain - 1 at each place, as a share of the best order's."""
    rel = relevant(qrels)
    gains = F.transform(F.slice(rank, 1, k), lambda d: F.coalesce(F.try_element_at(rel, d), F.lit(0)))
    best = F.slice(F.sort_array(F.map_values(rel), asc=False), 1, k)

    def dcg(g: Column) -> Column:
        return F.aggregate(F.transform(g, lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2((i + 2).cast("double"))), F.lit(0.0), lambda a, x: a + x)

    return _if_relevant(qrels, F.try_divide(dcg(gains), dcg(best)))


# Overlap of n-grams and subsequences.


def _grams(tokens: Sequence[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, a row of the table in the bits of one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("rouge_1", "rouge_2", "rouge_l")]))
def rouge(output: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """F1 of words, word pairs and the longest common subsequence; null if a text is missing."""
    rows = []
    for o, r in zip(output, ref):
        if o is None or r is None:
            rows.append((None, None, None))
            continue
        a, b = WORD.findall(o.casefold()), WORD.findall(r.casefold())
        out = []
        for n in (1, 2):
            x, y = _grams(a, n), _grams(b, n)
            total = x.total() + y.total()
            out.append(2 * (x & y).total() / total if total else 0.0)
        rows.append((*out, 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0))
    return pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l"])


_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _chrf_words(text: str) -> list[str]:
    """Words at white space, a punctuation sign at a word's end, or else at its beginning, being one of its own."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


@F.pandas_udf(T.DoubleType())
def chrf_pp(output: pd.Series, ref: pd.Series) -> pd.Series:
    """chrF++ : F2 of precision and recall, each averaged over the orders that both sides have of character n-grams 1..6 without white space and word n-grams 1..2."""

    def one(o: str | None, r: str | None) -> float | None:
        if o is None or r is None:
            return None
        sides = [("".join(o.split()), "".join(r.split()), 6), (_chrf_words(o), _chrf_words(r), 2)]
        found = []
        for x, y, most in sides:
            for n in range(1, most + 1):
                a, b = _grams(x, n), _grams(y, n)
                if a and b:
                    hit = (a & b).total()
                    found.append((hit / a.total(), hit / b.total()))
        if not found:
            return 0.0
        p, q = (sum(x) / len(found) for x in zip(*found))
        return 5 * p * q / (4 * p + q) if p + q else 0.0

    return pd.Series([one(o, r) for o, r in zip(output, ref)], dtype=object)


# The steps of the tokenization 13a, each a pattern and what it becomes.
TOKENS_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)
UNESCAPED_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_STEPS_13A = tuple((re.compile(a), b) for a, b in TOKENS_13A)


def tokens_13a(text: str) -> list[str]:
    """The words and signs of a text by the rules 13a, which published BLEU scores are stated by."""
    line = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        for a, b in UNESCAPED_13A:
            line = line.replace(a, b)
    line = f" {line} "
    for pattern, becomes in _STEPS_13A:
        line = pattern.sub(becomes, line)
    return line.split()


BLEU_STATS = (*(f"hit_{n}" for n in range(1, 5)), *(f"all_{n}" for n in range(1, 5)), "n_output", "n_reference")


@F.pandas_udf(_longs(*BLEU_STATS))
def bleu_stats(output: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """The ten sums of which corpus BLEU is made; they add up over rows, so a corpus needs one aggregation."""
    rows = []
    for o, r in zip(output, ref):
        a, b = tokens_13a(o or ""), tokens_13a(r or "")
        hits, total = [], []
        for n in range(1, 5):
            x, y = _grams(a, n), _grams(b, n)
            hits.append((x & y).total())
            total.append(x.total())
        rows.append((*hits, *total, len(a), len(b)))
    return pd.DataFrame(rows, columns=list(BLEU_STATS))


def bleu_of(sums: Mapping[str, Column], smooth: bool = False) -> Column:
    """BLEU in [0, 1] from the ten sums. smooth: halve the count of each further order without hits and drop orders without n-grams, for one sentence."""
    log_sum, orders, halvings = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    zero = F.lit(False)
    for n in range(1, 5):
        hit, total = sums[f"hit_{n}"].cast("double"), sums[f"all_{n}"].cast("double")
        if smooth:
            halvings = F.when((hit == 0) & (total > 0), halvings * 2).otherwise(halvings)
            p = F.when(hit > 0, hit / total).when(total > 0, 1 / (halvings * total))
            log_sum, orders = log_sum + F.coalesce(F.log(p), F.lit(0.0)), orders + _one(total > 0)
        else:
            zero = zero | (F.coalesce(hit, F.lit(0.0)) == 0)
            log_sum, orders = log_sum + F.coalesce(F.log(F.try_divide(hit, total)), F.lit(0.0)), orders + 1
    a, b = sums["n_output"].cast("double"), sums["n_reference"].cast("double")
    penalty = F.when(a >= b, 0.0).otherwise(1 - F.try_divide(b, a))
    if smooth:
        zero = F.coalesce(sums["hit_1"], F.lit(0)) == 0
    return F.when(zero | (a == 0) | (orders == 0), 0.0).otherwise(F.exp(penalty + log_sum / orders))


def _stem(w: str) -> str:
    for end in ("ational", "ization", "fulness", "ousness", "iveness", "ingly", "edly", "ing", "ies", "ied", "ed", "es", "ly", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


@F.pandas_udf(T.DoubleType())
def meteor(output: pd.Series, ref: pd.Series) -> pd.Series:
    """METEOR with exact and stem matches and no synonyms: weighted F times a penalty for broken order."""

    def one(o: str | None, r: str | None) -> float | None:
        if o is None or r is None:
            return None
        a, b = WORD.findall(o.casefold()), WORD.findall(r.casefold())
        used, pairs = set(), {}
        for form in (lambda w: w, _stem):
            free: dict[str, list[int]] = {}
            for j in reversed(range(len(b))):
                if j not in used:
                    free.setdefault(form(b[j]), []).append(j)
            for i, w in enumerate(a):
                if i not in pairs and free.get(form(w)):
                    pairs[i] = free[form(w)].pop()
                    used.add(pairs[i])
        if not pairs:
            return 0.0
        p, q = len(pairs) / len(a), len(pairs) / len(b)
        parts = sum(1 for i in pairs if pairs.get(i - 1) != pairs[i] - 1)
        return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (parts / len(pairs)) ** 3)

    return pd.Series([one(o, r) for o, r in zip(output, ref)], dtype=object)


# Vectors.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of no length or of another dimension."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def corpus_bleu(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, value): BLEU of each group's texts as one corpus, from sums; rows without output or reference are left out."""
    whole = F.col("output").isNotNull() & F.col("reference").isNotNull()
    stats = rows.select(*keys, F.when(whole, 1).alias("one"), bleu_stats(F.col("output"), F.col("reference")).alias("s"))
    sums = stats.groupBy(*keys).agg(F.count("one").alias("n"), *(F.coalesce(F.sum(F.when(F.col("one") == 1, F.col(f"s.{c}"))), F.lit(0)).alias(c) for c in BLEU_STATS))
    return sums.select(*keys, "n", F.coalesce(bleu_of({c: F.col(c) for c in BLEU_STATS}), F.lit(0.0)).alias("value"))


@dataclass(frozen=True)
class Metric:
    """A named score of one output; build takes the columns it names in needs."""

    name: str
    build: Callable[..., Column]
    needs: tuple[str, ...] = ("output", "reference")
    threshold: float = 0.5
    tasks: frozenset[str] = frozenset({"generation", "qa_short", "summarization", "rag"})
    family: str = "lexical"
    version: str = "1.0.0"
    config: Mapping = field(default_factory=dict)
    #: How scored rows become aggregates: mean (with Wilson interval), rate (an empty slice has no interval, no slice a deviation) or
    #: a function of the frame (keys..., slice, and the columns of needs) and the keys that gives (keys..., slice, n, value).
    aggregate: str | Callable[[DataFrame, Sequence[str]], DataFrame] = "mean"

    def value(self) -> Column:
        return self.build(*(F.col(c) for c in self.needs))


class Registry:
    """Metrics by name; a taken name is an error, families can be switched off with a reason."""

    def __init__(self, off: Mapping[str, str] | None = None) -> None:
        self._all: dict[str, Metric] = {}
        self._off = dict(off or {})

    def register(self, metric: Metric) -> None:
        if metric.name in self._all:
            raise ValueError(f"metric {metric.name} is registered already")
        self._all[metric.name] = metric

    def get(self, name: str) -> Metric:
        if name not in self._all:
            raise KeyError(f"unknown metric {name}")
        metric = self._all[name]
        if metric.family in self._off and name != "exact_match":
            raise LookupError(f"{name} is unavailable: {self._off[metric.family]}")
        return metric

    def names(self) -> list[str]:
        return sorted(self._all)


_EVERY = frozenset({"retrieval", "rag"})
REGISTRY = Registry()
for _m in (
    Metric("exact_match", lambda o, a, refs, r: exact_match(o, given_reference(a, refs, r)), ("output", "reference_answer", "references", "reference"), 1.0, aggregate="rate"),
    Metric("squad_f1", squad_f1),
    Metric("normalized_levenshtein", levenshtein_similarity, threshold=0.8),
    Metric("assertions", assertions, ("output", "must_contain", "must_not_contain"), 1.0),
    Metric("numeric_assertion", numeric_assertion, threshold=1.0),
    Metric("json_validity", lambda o, s: json_schema_validity(o, s), ("output", "json_schema"), 1.0, frozenset({"extraction", "generation", "tool_use"}), "structured"),
    Metric("json_field_f1", json_field_f1, ("output", "expected_json"), 0.5, frozenset({"extraction", "generation"}), "structured"),
    Metric("classification", classification, ("output", "expected_label"), 1.0, frozenset({"classification"}), "classification"),
    Metric("retrieval_ndcg_10", lambda o, q: ndcg_at(ranking(o), q), ("output", "qrels"), 0.0, _EVERY, "retrieval"),
    Metric("retrieval_precision_at_k", lambda o, q: precision_at(ranking(o), q), ("output", "qrels"), 0.0, _EVERY, "retrieval"),
    Metric("retrieval_mrr", lambda o, q: reciprocal_rank(ranking(o), q), ("output", "qrels"), 0.0, _EVERY, "retrieval"),
    Metric("retrieval_map", lambda o, q: average_precision(ranking(o), q), ("output", "qrels"), 0.0, _EVERY, "retrieval"),
    Metric("rouge_l", lambda o, r: rouge(o, r)["rouge_l"], family="overlap"),
    Metric("chrf_pp", chrf_pp, family="overlap"),
    Metric("sacrebleu", lambda o, r: (lambda s: bleu_of({k: s[k] for k in BLEU_STATS}, smooth=True))(bleu_stats(o, r)), family="overlap", aggregate=corpus_bleu),
    Metric("meteor", meteor, family="overlap"),
):
    REGISTRY.register(_m)
