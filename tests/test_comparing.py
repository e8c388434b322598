"""All overlaps against one pair at a time, findings as rows, and drift between runs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.joincheck import JoinCheck
from tallyframe.operators.overlap import all_overlaps, column_overlap
from tallyframe.plans.drift import distribution_drift, drift_classes, merged, value_histograms

PAIR = ["left_table", "left_column", "right_table", "right_column"]


def test_all_overlaps_equal_each_pair_alone(spark):
    pick = random.Random(4)
    maybe = lambda *v: pick.choice([None, *v])
    long = ["é" * 40 + c for c in "abc"]
    a = spark.createDataFrame(
        [(maybe(1, 2, 3), maybe(0.0, -0.0, 2.0, float("nan")), maybe("x", "", *long), dt.date(2024, 1, pick.randint(1, 4)), [1], "hot")
         for _ in range(60)], "i int, d double, s string, t date, l array<int>, h string")
    b = spark.createDataFrame(
        [(maybe(2, 9, 2**53 + 1), maybe("x", "1", *long[:2]), dt.datetime(2024, 1, pick.randint(3, 6)), maybe(True, False), maybe(2**53, 2))
         for _ in range(40)], "i bigint, s string, t timestamp, f boolean, j bigint")
    c = a.limit(0).select("i", "s")
    tables = {"a": a, "b": b, "c": c}
    got = {tuple(r[p] for p in PAIR): r for r in all_overlaps(tables).collect()}
    assert len(got) == 10 + 6 + 1  # pairs of five numbers, four texts, two times
    for (lt, lc, rt, rc), row in got.items():
        alone = column_overlap(tables[lt], lc, tables[rt], rc, left_table=lt, right_table=rt).first().asDict()
        mine = row.asDict()
        for field in ("left_n_rows", "left_n_null", "right_n_null") + (() if "c" in (lt, rt) else ("right_n_rows",)):
            assert mine[field] == alone[field], (lt, lc, rt, rc, field)
        for field in ("left_n_distinct", "right_n_distinct", "n_shared_values", "n_left_only_values", "n_right_only_values"):
            assert mine[field] == alone[field], (lt, lc, rt, rc, field)
        for field in ("left_coverage", "right_coverage"):
            assert mine[field] == pytest.approx(alone[field]), (lt, lc, rt, rc, field)
        assert alone["comparable_types"]
    assert not any("l" in (k[1], k[3]) for k in got)
    assert got["b", "i", "b", "j"].n_shared_values == 1  # whole numbers beyond a double's reach stay apart
    with pytest.raises(ValueError, match="no columns"):
        all_overlaps({"a": a}, {"a": []})


def test_findings_are_the_same_as_rows(spark, orders, customers):
    extra = orders.unionByName(spark.createDataFrame([(1, 1001.0, None), (2, None, 3)], orders.schema))
    check = JoinCheck(extra, customers, on="customer_id")
    found = check.findings()["evidence"]
    rows = {}
    for r in check.evidence().orderBy("evidence", "place").collect():
        value = json.loads(r.row)
        if r.evidence == "fan_out_examples":
            value = {"key": value["customer_id"], "n_left": r.n_left, "n_right": r.n_right}
        rows.setdefault(r.evidence, []).append(value)
    assert rows == {k: v for k, v in found.items() if v}
    none = JoinCheck(extra.limit(0), customers.limit(0), on="customer_id")
    assert none.evidence().count() == 0


def test_evidence_reads_each_side_once_beside_the_counts(spark):
    left = spark.range(100).selectExpr("id AS k", "string(id) AS wide")
    check = JoinCheck(left, left.where("k > 50"), on="k")
    plan = check._marked_rows("left")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [(r.evidence, r.place, json.loads(r.row)["k"]) for r in check._marked_rows("left").orderBy("place").collect()] == [
        ("unmatched_left_rows", n + 1, n) for n in range(3)]


def test_drift_classes_tell_invariants_from_measures(spark):
    schema = "run string, model string, step_pos int, step string, op string, part string, field string, value string"
    row = lambda run, step, part, field, value: (run, "m", 0, step, "join", part, field, value)
    a = spark.createDataFrame([
        row("a", "s", "provenance", "relationship", "many:1"), row("a", "s", "provenance", "result_rows", "100"),
        row("a", "s", "outcome", "null_rates.x", "0.5"), row("a", "s", "blocking", "empty_output", "true"),
        row("a", "s", "provenance", "same", "1"), row("a", "t", "provenance", "sql", "SELECT 1"), row("a", "t", "outcome", "n", None)], schema)
    b = spark.createDataFrame([
        row("b", "s", "provenance", "relationship", "many:many"), row("b", "s", "provenance", "result_rows", "150"),
        row("b", "s", "outcome", "null_rates.x", "0"), row("b", "s", "provenance", "same", "1"),
        row("b", "t", "provenance", "sql", "SELECT 2"), row("b", "t", "outcome", "grain[0].unique", "false"), row("b", "t", "outcome", "n", None)], schema)
    got = {(r.step, r.field): (r["class"], r.before, r.after, round(r.distance, 4)) for r in drift_classes(a, b).collect()}
    assert got == {
        ("s", "relationship"): ("invariant", "many:1", "many:many", 1.0), ("s", "result_rows"): ("measure", "100", "150", 0.3333),
        ("s", "null_rates.x"): ("measure", "0.5", "0", 1.0), ("s", "empty_output"): ("gone", "true", None, 1.0),
        ("t", "sql"): ("text", "SELECT 1", "SELECT 2", 1.0), ("t", "grain[0].unique"): ("new", None, "false", 1.0)}
    assert drift_classes(a, a).count() == 0 and drift_classes(a.limit(0), b.limit(0)).count() == 0


def test_distributions_drift_by_the_share_of_rows_that_move(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z" * 90, 2)], "s string, n int")
    b = spark.createDataFrame([("x", 1), ("w", None)], "s string, n int")
    got = {r["column"]: r for r in distribution_drift(value_histograms(a), value_histograms(b)).collect()}
    assert (got["s"].rows_before, got["s"].rows_after, got["s"].values_gone, got["s"].values_new, got["s"].rows_new) == (4, 2, 2, 1, 1)
    assert got["s"].distance == pytest.approx((0 + 0.25 + 0.25 + 0.5) / 2) and got["n"].distance == pytest.approx(0.25)
    whole = {r["column"]: r.distance for r in distribution_drift(value_histograms(a), value_histograms(a)).collect()}
    assert whole == {"s": 0.0, "n": 0.0}
    parts = merged([value_histograms(a.limit(0)), value_histograms(a), value_histograms(b)])
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, value_histograms(a.unionByName(b)).collect()), key=str)
    one_sided = distribution_drift(value_histograms(a), value_histograms(b.limit(0))).where(F.col("column") == "s").first()
    assert one_sided.rows_after == 0 and one_sided.distance is None
