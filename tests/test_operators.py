"""Roll-ups, comparison, sinks, plans, artifacts, judging, evidence, vectors and graphs on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from verdigrade.operators import artifacts, compare, graph, judging, plan, rag, rollup, sinks, skew, validate, vectors
from verdigrade.session import clear, materialize


def test_rollup_of_nothing_and_nulls(spark):
    rows = [("r", {"d": "x"}, 1.0), ("r", {"d": "x"}, None), ("r", {"d": "y"}, None), ("r", None, 0.0), ("r", {"own": "k1"}, 0.5)]
    df = spark.createDataFrame(rows, "run string, slices map<string,string>, value double").withColumn("threshold", F.lit(0.5))
    dims = rollup.kept_dimensions(df.unionByName(df.select("run", F.create_map(F.lit("own"), F.col("run")).alias("slices"), "value", "threshold")), most=1)
    got = {r.slice: r for r in rollup.score_rollup(df, ["run"], spark.createDataFrame([("d", 2)], "dimension string, n_values int")).collect()}
    assert set(got) == {"__overall__", "d=x", "d=y"} and dims.count() == 0
    assert (got["__overall__"].n, got["__overall__"].value) == (3, 0.5) and got["d=y"].n == 0 and got["d=y"].value == 0.0 and got["d=y"].stddev is None and (got["d=y"].ci_low, got["d=y"].ci_high) == (0.0, 0.0)
    assert rollup.score_rollup(df.limit(0), ["run"], dims).count() == 0


def test_classification_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), (None, "a")], "e string, p string")
    r = rollup.classification_report(rollup.confusion(df, "e", "p")).first()
    assert (r.n, r.accuracy, r.balanced_accuracy) == (4, 0.5, 0.5) and r.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3) and r.kappa == pytest.approx((0.5 - 0.375) / 0.625)


def test_compare(spark):
    df = spark.createDataFrame([(c, i, o, n) for c in range(10) for i, (o, n) in enumerate([(True, c < 8), (True, c < 8)])], "case int, rep int, old boolean, new boolean")
    r = compare.compare_binary(df).first()
    assert (r.n, r.only_baseline, r.only_candidate) == (20, 4, 0) and r.p_value == pytest.approx(2 / 16) and r.delta == pytest.approx(-0.2)
    assert compare.flaky(df, "case").count() == 0
    d = compare.delta_interval(df).first()
    assert d.ci_low < d.delta == pytest.approx(-0.2) and d.ci_high <= 0.0


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "b"), (3, "b"), (None, "b")], "k int, v string")
    assert sorted(sinks.first_wins(old, new, ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "a"), (None, "a"), (3, "b")], key=str)
    assert {(r.k, r.v) for r in sinks.last_wins(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "b"), (None, "b")}
    assert sinks.without(old, new, ["k"]).where("k is not null").count() == 1
    path = str(tmp_path / "t")
    for df in (old, new, new):
        sinks.append_first_wins(spark, path, df, ["k"])
    assert spark.read.parquet(path).count() == 4
    path = str(tmp_path / "u")
    a = spark.createDataFrame([("r1", 1, "x"), ("r2", 1, "x")], "run string, k int, v string")
    sinks.upsert_partitions(spark, path, a, ["run", "k"], "run")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([("r1", 1, "y"), ("r1", 2, "y")], "run string, k int, v string"), ["run", "k"], "run")
    assert {(r.run, r.k, r.v) for r in spark.read.parquet(path).collect()} == {("r1", 1, "y"), ("r1", 2, "y"), ("r2", 1, "x")}
    sinks.write_atomic({tmp_path / "a.json": "1", tmp_path / "b" / "c.html": "2"})
    assert (tmp_path / "b" / "c.html").read_text() == "2" and sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["a.json"]


def test_materialize(spark):
    df = spark.createDataFrame([(1, {"a": "b"}, [1.5])], "k int, m map<string,string>, v array<double>")
    kept = materialize(df)
    assert kept.collect() == df.collect() and materialize(df.limit(0)).count() == 0
    clear(spark)
    with pytest.raises(Exception):
        kept.collect()


def test_salted_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(400)] + [(999, None)], "i int, key string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("nobody", 3)], "key string, v int")
    hot = skew.hot_keys(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", one_in=10)
    assert [r.key for r in hot.collect()] == ["hot"]
    plain = sorted(map(str, left.join(right, "key", "left").collect()))
    assert sorted(map(str, skew.salted_join(left, right, "key", "left", hot, [F.col("i")]).select("key", "i", "v").collect())) == plain
    assert skew.salted_join(left, right, "key", "inner", hot, [F.col("i")]).count() == 201
    with pytest.raises(ValueError):
        skew.salted_join(left, right, "key", "full", hot, [F.col("i")])


def test_plan_and_sample(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    done = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], "case_id string, repeat_idx int")
    assert {tuple(r) for r in plan.remaining(cases, 2, done).collect()} == {("a", 1), ("b", 0)}
    df = spark.createDataFrame([(f"c{i}",) for i in range(100)] + [(None,)], "id string")
    a, b = (plan.seeded_sample(df.repartition(n), "id", 7, 10).collect() for n in (1, 5))
    assert a == b and len(a) == 10 and [r.id for r in a] == sorted(r.id for r in a)


def test_gates_and_artifacts(spark):
    rows = spark.createDataFrame([("r", 0.99, None), ("q", 0.5, 100.0)], "run string, coverage double, p95 double")
    gates = artifacts.evaluate_gates(rows, {"coverage": ("coverage", ">=", 0.98, True), "latency": ("p95", "<=", 200.0, False)}, "run")
    assert {(r.run, r.gate): r.passed for r in gates.collect()} == {("r", "coverage"): True, ("r", "latency"): False, ("q", "coverage"): False, ("q", "latency"): True}
    assert {r.run: r.passed for r in artifacts.roll_up(gates, "run").collect()} == {"r": True, "q": False}
    cmp = spark.createDataFrame([(-0.1, 0.01, -0.3), (-0.1, 0.2, -0.3), (0.1, 0.01, 0.3)], "delta double, p_value double, cohens_h double")
    assert [r.passed for r in artifacts.regression_gate(cmp).collect()] == [False, True, True]
    rep = [artifacts.report_json("n <", {"gates": gates}, {"gates": ["run", "gate"]}) for _ in range(2)]
    assert json.dumps(rep[0]) == json.dumps(rep[1]) and "n &lt;" in artifacts.report_html(rep[0]) and 'failures="2"' in artifacts.report_junit("s", rep[0]["gates"])
    assert artifacts.identity({"a": 1, "digest": "x"}, ["digest"]) == artifacts.identity({"a": 1, "digest": "y"}, ["digest"])
    assert [r.m for r in artifacts.missing_references(spark.createDataFrame([("a",), ("b",), (None,)], "m string"), "m", spark.createDataFrame([("a",)], "name string"), "name").collect()] == ["b"]


def test_judging(spark):
    items = spark.createDataFrame([("x", "y", 0, "A"), ("x", "y", 1, "B"), ("y", "z", 0, "tie"), ("x", "y", 1, "A")], "model_a string, model_b string, swap int, shown string").withColumn("preference", judging.original_preference(F.col("shown"), F.col("swap")))
    w = {r.model: (r.wins, r.decided) for r in judging.win_rates(items).collect()}
    assert w == {"x": (2, 3), "y": (1, 3)}
    assert judging.position_bias(items).first()[:] == (3, pytest.approx(2 / 3))
    assert judging.position_bias(items.where("shown = 'tie'")).first()[1] is None
    with pytest.raises(Exception, match="label is missing"):
        judging.require_total(spark.createDataFrame([(1, None)], "a int, label string"), "label", "label").collect()
    with pytest.raises(Exception, match="more than once"):
        judging.one_to_one(spark.createDataFrame([(1, 2), (1, 3)], "k int, a int"), spark.createDataFrame([(1, 2)], "k int, b int"), "k").collect()
    s = spark.createDataFrame([(5, 50, "a", " A", None), (50, 50, "a", "b", 0.9)], "n_dev int, n_holdout int, judge_family string, candidate_family string, agreement double")
    assert [(len(r.reasons), r.gating_allowed) for r in judging.calibration_gate(s, "agreement", 0.8, 20, 20).collect()] == [(3, False), (0, True)]


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("f", "e"), ("d", "c")], "a string, b string")
    assert {(r.component, r["size"]) for r in graph.component_sizes(graph.components(nodes, edges)).collect()} == {("a", 4), ("e", 2), ("g", 1)}


def test_evidence(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"]), (["a"], []), (["a"], None)], "got array<string>, want array<string>")
    assert [(r.context_precision, r.context_recall) for r in rag.context_scores(df, "got", "want").collect()] == [(pytest.approx(2 / 3), 0.5), (0.0, 0.0), (0.0, 0.0), (None, None)]
    e = spark.createDataFrame([(1, 0, "neutral"), (1, 0, "entailment"), (1, 1, "contradiction"), (2, 0, None)], "k int, c int, label string")
    assert rag.unsupported_rate(e, ["k", "c"]).first()[:] == (3, pytest.approx(2 / 3))
    c = spark.createDataFrame([(True, False, True), (True, None, None), (None, True, True)], "present boolean, relevant boolean, entailed boolean")
    assert rag.citation_attribution(c).first()[:] == (3, pytest.approx(1 / 3)) and rag.citation_attribution(c.limit(0)).first()[1] is None


def test_nearest(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 8), (301, None), (302, [1.0] * 3), (303, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df.where("vec_id % 20 = 0"), df, 5, per_block=64).collect():
        got.setdefault(r.query_id, {})[r.place] = r.vec_id
    y = np.vstack([x, x[:1]])
    ids = [*range(300), 303]
    for q in range(0, 300, 20):
        sim = y @ y[q] / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q])
        want = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(sim[j], 12), ids[j]))[:5]
        assert [got[q][p] for p in range(1, 6)] == [ids[j] for j in want]
    assert 300 not in got


def test_validation(spark, tmp_path):
    c = spark.createDataFrame([("a", "qa_short", "x", "y", 1.0, {"d": "1"}), ("b", "nope", "x" * 2001, None, 0.0, None), ("c", "rag", None, "y", 1.0, {})], "id string, task string, inputs string, ref string, weight double, slices map<string,string>")
    rules = validate.case_rules(F.col("inputs"), F.col("ref"), F.col("weight"), F.col("slices"), F.col("task"), ["d"])
    assert {tuple(r) for r in validate.breaches(c, "id", rules).collect()} == {("unknown_task", "b"), ("inputs_too_long", "b"), ("no_reference", "b"), ("weight_not_positive", "b"), ("undeclared_slices", "b"), ("no_inputs", "c"), ("undeclared_slices", "c")}
    full = {k: "x" for k in validate.PROVENANCE}
    v = spark.createDataFrame([("a", "qa_short", full), ("b", "rag", full | {"source_id": " "}), ("c", "retrieval", None)], "id string, task string, p map<string,string>")
    assert {tuple(r) for r in validate.breaches(v, "id", validate.versioned_rules(F.col("p"), F.col("task"), ["exact_match"])).collect()} == {("no_provenance", "b"), ("no_provenance", "c"), ("no_fitting_metric", "c")}
    m = {"license": "CC-BY-4.0", "split": "holdout", "pii_scrubbed": True, "schema_version": "0.1", "tier": "smoke", "adapter": {"sample_size": 4}, "source": {"redistributable_smoke": True}, "pii_scrub_procedure": "", "content_sha256": "x"}
    assert len(validate.manifest_errors(m, 3, "y")) == 9
    assert validate.jailed(str(tmp_path), "a/b").name == "b"
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            validate.jailed(str(tmp_path), bad)


def test_event_windows(spark):
    from verdigrade.streaming import monitor

    t = dt.datetime(2025, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=10 * i), 1, "error" if i < 7 else "ok") for i in range(12)] + [(99, None, 1, "ok"), (100, t, None, "ok"), (101, t, 2, "ok")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").withColumn("value", F.lit(1.0))
    got = {r.user_id: (r.n_calls, r.n_rejected, r.n_opened) for r in monitor.breaker_replay(df, limit=3, cooldown=25.0).collect()}
    # opens at call 2, rejects 3 and 4, trial 5 fails and opens again, rejects 6 and 7, trial 8 closes it
    assert got == {1: (12, 4, 2), 2: (1, 0, 0)}
    assert monitor.sessions(df, "15 seconds").where("user_id = 1").first().n == 12


def test_slices_of_more_than_10000_dimensions(spark):
    df = spark.range(10_050).select(F.lit("r").alias("run"), F.create_map(F.concat(F.lit("d"), F.col("id").cast("string")), F.lit("x")).alias("slices"))
    got = rollup.by_slice(df, "slices", rollup.kept_dimensions(df), [F.count(F.lit(1)).alias("n")], ["run"])
    assert got.count() == 10_051


def test_fields_follow_the_task_and_each_text_is_bounded(spark):
    rows = [("1", "retrieval", None, {"d1": 1}, {"q": "x" * 1500, "r": "y" * 1500}), ("2", "retrieval", "answer", None, {"q": "x"}), ("3", "qa_short", "a", None, {"q": "x" * 2001}), ("4", "rag", "a", None, {"q": 'say "' + "z" * 1990}), ("5", "generation", None, None, {"q": "x"})]
    cases = spark.createDataFrame(rows, "id string, task_type string, reference_answer string, qrels map<string,int>, inputs map<string,string>").withColumns({"weight": F.lit(1.0), "slices": F.create_map().cast("map<string,string>")})
    rules = validate.case_rules(F.to_json("inputs"), F.col("reference_answer"), F.col("weight"), F.col("slices"), F.col("task_type"), [], needed=validate.missing_fields(cases), texts=validate.json_texts("inputs"))
    assert {(r.rule, r.case_id) for r in validate.breaches(cases, "id", rules).collect()} == {("no_reference", "2"), ("no_reference", "4"), ("inputs_too_long", "3")}


def test_get_or_create(spark, tmp_path):
    path, row = str(tmp_path / "datasets"), {"name": "d", "version": "1", "content_sha256": "x", "id": 7}
    assert sinks.get_or_create(spark, path, row, ["name", "version"], "content_sha256") == row
    assert sinks.get_or_create(spark, path, row | {"id": 8}, ["name", "version"], "content_sha256")["id"] == 7
    with pytest.raises(ValueError):
        sinks.get_or_create(spark, path, row | {"content_sha256": "y"}, ["name", "version"], "content_sha256")
    sinks.get_or_create(spark, path, row | {"version": "2", "content_sha256": "y"}, ["name", "version"], "content_sha256")
    assert spark.read.parquet(path).count() == 2


def test_batches_read_the_partitions_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "a", 2), (3, "b", 2), (4, None, 2)], [(4, None, 3), (5, "c", 3)]):
        sinks.append_first_wins(spark, path, spark.createDataFrame(rows, "id int, day string, v int"), ["id", "day"], ["day"])
    assert {(r.id, r.day): r.v for r in spark.read.parquet(path).collect()} == {(1, "a"): 1, (2, "b"): 1, (3, "b"): 2, (4, None): 2, (5, "c"): 3}
