"""Metrics on hand-made rows: values, nulls, empty texts."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigrade.functions import metrics as m
from verdigrade.functions import text as t

PAIRS = [("The cat sat.", "the cat sat"), ("", ""), (None, "x"), ("x", None), ("a b c d", "b c"), ("Straße 12,5 km", "strasse 12.5 km"), ("x" * 5000, "x" * 4999)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, output string, reference string")


def values(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_exact_and_f1(pairs):
    assert values(pairs, m.exact_match(F.col("output"), F.col("reference")))[:5] == [0.0, 1.0, None, None, 0.0]
    f1 = values(pairs, m.squad_f1(F.col("output"), F.col("reference")))
    assert f1[:4] == [1.0, 1.0, None, None] and f1[4] == pytest.approx(2 / 3)
    assert f1[5] == pytest.approx(1.0)  # case folding: ß is ss


def test_overlap(pairs):
    r = [x[0] for x in pairs.orderBy("i").select(m.rouge(F.col("output"), F.col("reference"))).collect()]
    assert r[0].rouge_l == 1.0 and r[2].rouge_l is None and r[4].rouge_1 == pytest.approx(2 / 3) and r[4].rouge_2 == pytest.approx(2 / 4) and r[1].rouge_l == 0.0
    c = values(pairs, m.chrf_pp(F.col("output"), F.col("reference")))
    assert c[2] is None and c[1] == 0.0 and 0 < c[4] < 1
    me = values(pairs, m.meteor(F.col("output"), F.col("reference")))
    assert me[0] == pytest.approx(1 - 0.5 / 27) and me[1] == 0.0 and me[3] is None


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert m.lcs_length(a, b) == d[-1][-1]


def test_numbers_assertions_levenshtein(spark, pairs):
    df = spark.createDataFrame([("1 and 2.0", "1.0 2"), ("none", "nothing"), ("1", "1 2"), ("1e", "3")], "o string, r string")
    assert [r[0] for r in df.select(m.numeric_assertion(F.col("o"), F.col("r"))).collect()] == [1.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([("All GOOD here", ["good"], ["bad"]), ("bad", [], ["BAD"]), (None, [], []), ("x", None, None)], "o string, y array<string>, n array<string>")
    assert [r[0] for r in df.select(m.assertions(F.col("o"), F.col("y"), F.col("n"))).collect()] == [1.0, 0.0, 0.0, 1.0]
    lev = values(pairs, m.levenshtein_similarity(F.col("output"), F.col("reference")))
    assert lev[1] == 1.0 and lev[2] is None and lev[6] == pytest.approx(1 - 1 / 5000)


def test_json(spark):
    schema = json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}})
    rows = [('{"a": 1, "b": [1, {"c": null}]}', '{"a": 1, "b": [1, {"c": null}]}'), ("[1", "{}"), (None, '{"a": 1}'), ('{"a": 0}', None), ('{"a": 2}', '{"a": 2, "z": null}')]
    df = spark.createDataFrame([(i, *r, schema) for i, r in enumerate(rows)], "i int, o string, e string, s string").orderBy("i")
    assert [r[0] for r in df.select(m.json_validity(F.col("o"))).collect()] == [1.0, 0.0, 0.0, 1.0, 1.0]
    assert [r[0] for r in df.select(m.json_schema_validity(F.col("o"), F.col("s"))).collect()] == [1.0, 0.0, 0.0, 0.0, 1.0]
    f1 = [r[0] for r in df.select(m.json_field_f1(F.col("o"), F.col("e"))).collect()]
    assert f1[0] == 1.0 and f1[1] == 0.0 and f1[2] == 0.0 and f1[3] is None and f1[4] == pytest.approx(4 / 3)  # an absent field meets an expected null


def test_ranking(spark):
    rows = [('["d1", "d2", "d2"]', {"d1": 3, "d2": 1}), ("d3, d1", {"d1": 1, "d9": 0}), (None, {"d1": 1}), ("d1", {"d1": 0}), ("d1", {})]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o string, q map<string,int>").withColumn("r", m.ranking(F.col("o"))).orderBy("i")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(m.ndcg_at(F.col("r"), F.col("q")))[0] == pytest.approx(1.0)
    assert get(m.reciprocal_rank(F.col("r"), F.col("q"))) == [1.0, 0.5, 0.0, None, None]
    assert get(m.average_precision(F.col("r"), F.col("q"))) == [1.0, 0.5, 0.0, None, None]
    assert get(m.precision_at(F.col("r"), F.col("q"), 10)) == [0.2, 0.1, 0.0, None, None]


def test_bleu(spark):
    df = spark.createDataFrame([("the cat is on the mat now", "the cat is on the mat now"), ("a", "a b c d e"), ("", "x")], "o string, r string").select(m.bleu_stats(F.col("o"), F.col("r")).alias("s")).select("s.*")
    got = [r[0] for r in df.select(m.bleu_of({c: F.col(c) for c in m.BLEU_STATS}, smooth=True)).collect()]
    assert got[0] == pytest.approx(1.0) and got[2] == 0.0


def test_registry():
    r = m.Registry({"overlap": "not installed"})
    r.register(m.REGISTRY.get("rouge_l"))
    with pytest.raises(LookupError):
        r.get("rouge_l")
    with pytest.raises(ValueError):
        r.register(m.REGISTRY.get("rouge_l"))
    with pytest.raises(KeyError):
        r.get("no such metric")


def test_text(spark):
    df = spark.createDataFrame([(0, "  a  b\n"), (1, None), (2, "x" * 300), (3, "See Fig. 2. It works! Why?\nNext line")], "i int, s string").orderBy("i")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(t.truncate(F.col("s"), 280))[:2] == ["a b", None] and len(get(t.truncate(F.col("s"), 280))[2]) == 280
    assert get(t.claims(F.col("s")))[3] == ["See Fig. 2.", "It works!", "Why?", "Next line"]
    assert get(t.normalized(F.lit("The  ﬁrst, Man-of war!")))[0] == "first man-of war"
    assert get(t.redact(F.lit("api_key=abc token: q, Authorization: Bearer zz")))[0] == "api_key=[REDACTED] token: [REDACTED], Authorization: [REDACTED]"
    assert get(t.without_fence(F.lit("```json\n{}\n```")))[0] == "{}"
    assert get(t.rendered("Q: {{ q }}{{ z }}", F.create_map(F.lit("q"), F.lit("why"))))[0] == "Q: why"


def test_shown(spark):
    df = spark.createDataFrame([({"q": "why"}, "a", None, None, None), ({"b": "1", "a": "2"}, "", None, None, ["x", "y"]), (None, None, "l", "{}", None)], "i map<string,string>, a string, l string, j string, r array<string>")
    got = df.select(t.shown_inputs(F.col("i")), t.shown_reference(F.col("a"), F.col("l"), F.col("j"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("why", "a"), ('{"a":"2","b":"1"}', "x; y"), (None, "l")]


def test_levenshtein_of_raw_texts(spark, tmp_path, monkeypatch):
    from verdigrade.plans import metrics as plans

    texts = [("Ответ", "Пример"), ("é", "e"), ("答え", "答"), ("", ""), ("naïve café", "naive cafe"), (None, "x")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "example_id long, output string, reference string")
    monkeypatch.setattr(plans, "_pairs", lambda s, d: df)

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0

    got = {r.example_id: r.value for r in plans.QUERIES["normalized_levenshtein_raw"](spark, "").collect()}
    assert got == {i: pytest.approx(brute(a, b)) if a is not None else None for i, (a, b) in enumerate(texts)}


def test_tokens_13a():
    assert m.tokens_13a("It costs 3.14, e.g. in the U.S.; well-known &amp; cheap") == ["It", "costs", "3.14", ",", "e", ".", "g", ".", "in", "the", "U", ".", "S", ".", ";", "well-known", "&", "cheap"]
    assert m.tokens_13a("in 1990-95 a\nline -\nbreak") == ["in", "1990", "-", "95", "a", "line", "break"] and m.tokens_13a("") == []


def test_chrf_averages_precision_and_recall(spark):
    """By hand: of 'ab c' against 'ab d', orders 1 and 2 of characters, 1 and 2 of words and order 3 of characters exist on both sides."""
    df = spark.createDataFrame([("ab c", "ab d"), ("same text here", "same text here"), ("", "x"), ("x", None)], "o string, r string")
    got = [r[0] for r in df.select(m.chrf_pp(F.col("o"), F.col("r"))).collect()]
    p = (2 / 3 + 1 / 2 + 0 + 1 / 2 + 0) / 5
    assert got[0] == pytest.approx(p) and got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] is None
    assert m._chrf_words('He said: "no." (yes)') == ["He", "said", ":", '"no.', '"', "(yes", ")"]


def test_exact_match_keeps_an_empty_reference(spark):
    from verdigrade import pipeline

    rows = spark.createDataFrame([("a", "", ["x"], ""), ("b", None, ["x"], "x"), ("c", "y", ["x"], "x"), ("d", None, None, "x")], "id string, reference_answer string, references array<string>, output string")
    got = {(r.id, r.metric): r.value for r in pipeline.score(rows, ["exact_match", "squad_f1"]).collect()}
    assert [got[i, "exact_match"] for i in "abcd"] == [1.0, 1.0, 0.0, None] and got["a", "squad_f1"] == 0.0


def test_json_validity_looks_at_the_schema(spark):
    from verdigrade import pipeline

    rows = spark.createDataFrame([("a", '{"x": 1}', '{"type": "object", "required": ["x"]}'), ("b", "{}", '{"required": ["x"]}'), ("c", "{}", None), ("d", "{", None)], "id string, output string, json_schema string").withColumn("task_type", F.lit("extraction"))
    assert {r.id: r.value for r in pipeline.score(rows, ["json_validity"]).collect()} == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.0}


def test_corpus_bleu_and_rates_are_aggregates_of_their_own(spark):
    from verdigrade import pipeline

    cases = spark.createDataFrame([("1", "the cat is on the mat now", {"d": "a"}, "qa_short"), ("2", "one two three four five six", {"d": "b"}, "qa_short")], "id string, reference_answer string, slices map<string,string>, task_type string")
    g = spark.createDataFrame([("r", "1", 0, "the cat is on the mat now"), ("r", "2", 0, "one two three four five seven")], "run_id string, case_id string, repeat_idx int, output string")
    names = ["exact_match", "sacrebleu"]
    scored = pipeline.score(g.join(cases.withColumnRenamed("id", "case_id"), "case_id"), names)
    got = {(r.metric, r.slice): r for r in pipeline.aggregates(scored, g, cases, names).collect()}
    p = [12 / 13, 10 / 11, 8 / 9, 6 / 7]
    assert got["sacrebleu", "__overall__"].value == pytest.approx(float(np.exp(np.mean(np.log(p))))) and got["sacrebleu", "d=a"].value == pytest.approx(1.0) and got["sacrebleu", "d=a"].ci_low is None
    assert got["exact_match", "__overall__"].value == 0.5 and got["exact_match", "__overall__"].stddev is None and got["exact_match", "d=b"].n == 1


def test_an_empty_slice_of_a_rate_has_no_interval(spark):
    from verdigrade.operators import rollup

    rows = spark.createDataFrame([("r", m_, {"d": "a"}, None, 1.0) for m_ in ("exact_match", "rouge_l")], "run_id string, metric string, slices map<string,string>, value double, threshold double")
    dims = spark.createDataFrame([("d", 1)], "dimension string, n_values int")
    got = {(r.metric, r.slice): (r.n, r.value, r.ci_low, r.stddev) for r in rollup.score_rollup(rows, ["run_id", "metric"], dims, rates=("exact_match",)).collect()}
    assert got["exact_match", "d=a"] == (0, 0.0, None, None) and got["rouge_l", "d=a"] == (0, 0.0, 0.0, None)
