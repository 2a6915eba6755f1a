"""Orphan references: time rules, key rule, copies, hot keys, empty tables."""

import datetime as dt

import pytest

from verdigrade.operators.references import Reference, orphan_references, orphan_report

D = lambda d: dt.datetime(2025, 1, d)
REFS = (Reference("judged", "id", "key", "at", "things", "key"),)


@pytest.fixture(scope="module")
def parents(spark):
    rows = [(" A ", D(1), None), ("a", D(5), None), ("b", D(1), None), ("B\n", D(9), D(8)), ("late", D(20), None), ("", D(1), None), (None, D(1), None), ("nul", None, None)]
    return {"things": spark.createDataFrame([(*r, 7, "clash") for r in rows], "key string, loaded_at timestamp, deleted_at timestamp, t int, found string")}


def orphans(spark, parents, rows):
    child = spark.createDataFrame([(*r, 1) for r in rows], "id long, key string, at timestamp, born int")
    return {r.ref_id: r.reason for r in orphan_references({"judged": child}, parents, REFS).collect()}


def test_rules(spark, parents):
    rows = [(1, "A\t", D(3)), (2, "b", D(7)), (3, "b", D(8)), (4, "LATE", D(3)), (5, "gone", D(3)), (6, None, D(3)), (7, "  ", D(3)), (8, "gone", None), (9, "b", None), (5, "gone", D(3)), (10, "nul", D(1))]
    assert orphans(spark, parents, rows) == {3: "deleted", 4: "late", 5: "missing", 8: "missing"}


def test_hot_key(spark, parents):
    rows = [(i, "gone" if i % 3 else "b", D(3)) for i in range(3000)]
    assert set(orphans(spark, parents, rows)) == {i for i in range(3000) if i % 3}


def test_empty(spark, parents):
    assert orphans(spark, parents, []) == {}
    none = {"things": parents["things"].limit(0)}
    assert orphans(spark, none, [(1, "a", D(1))]) == {1: "missing"}


def test_report(spark, parents):
    child = spark.createDataFrame([(1, "a", D(3)), (1, "a", D(3)), (2, "gone", D(3)), (3, "gone", None)], "id long, key string, at timestamp")
    got = {(r.period, r.n_references, r.n_orphans, r.n_missing) for r in orphan_report({"judged": child}, parents, REFS).collect()}
    assert got == {("2025-01", 2, 1, 1), (None, 1, 1, 1)}


def found(spark, parents, rows, ids="long"):
    child = spark.createDataFrame(rows, f"id {ids}, key string, at timestamp")
    return sorted((str(r.ref_id), r.k, r.t, r.reason) for r in orphan_references({"judged": child}, parents, REFS).collect())


def test_rows_without_id_are_each_a_reference(spark, parents):
    rows = [(None, "gone", D(3)), (None, "gone", D(3)), (None, "a", D(3)), (1, "gone", D(3))]
    assert found(spark, parents, rows) == [("1", "gone", D(3), "missing")] + [("None", "gone", D(3), "missing")] * 2
    child = spark.createDataFrame(rows, "id long, key string, at timestamp")
    assert [(r.n_references, r.n_orphans) for r in orphan_report({"judged": child}, parents, REFS).collect()] == [(4, 3)]


def test_many_rows_without_id_under_one_key(spark, parents):
    child = spark.range(5000).selectExpr("cast(null as string) as id", "'gone' as key", "timestamp'2025-01-03' as at")
    assert orphan_references({"judged": child}, parents, REFS).count() == 5000


def test_null_time_keeps_its_key(spark, parents):
    assert found(spark, parents, [(1, "gone", None)]) == [("1", "gone", None, "missing")]
    assert found(spark, parents, [(1, "gone", None), (1, "other", D(4))]) == [("1", "other", D(4), "missing")]


def test_key_time_and_reason_are_of_one_copy(spark, parents):
    assert found(spark, parents, [(1, "late", D(2)), (1, "gone", D(3))]) == [("1", "late", D(2), "late")]
    assert found(spark, parents, [(1, "late", D(3)), (1, "gone", D(3))]) == [("1", "gone", D(3), "missing")]


def test_ids_of_any_type(spark, parents):
    assert found(spark, parents, [("x-1", "gone", D(3)), ("x-2", "a", D(3))], "string") == [("x-1", "gone", D(3), "missing")]
    two = (*REFS, Reference("other", "id", "key", "at", "things", "key"), Reference("other", "id", "also", "at", "things", "key"))
    children = {"judged": spark.createDataFrame([(1, "gone", D(3))], "id long, key string, at timestamp"), "other": spark.createDataFrame([("x", "gone", "none", D(3))], "id string, key string, also string, at timestamp")}
    got = {(r.ref_table, r.ref_key, r.ref_id, r.k) for r in orphan_references(children, parents, two).collect()}
    assert got == {("judged", "key", "1", "gone"), ("other", "key", "x", "gone"), ("other", "also", "x", "none")}


def test_copies_at_other_times_are_one_reference(spark, parents):
    child = spark.createDataFrame([(1, "gone", dt.datetime(2025, 2, 1)), (1, "a", D(3))], "id long, key string, at timestamp")
    assert [(r.period, r.n_references, r.n_orphans) for r in orphan_report({"judged": child}, parents, REFS).collect()] == [("2025-01", 1, 1)]
