"""As-of, interval and band joins, and running sums, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import interval
from tallyframe.operators.asof import asof_join
from tallyframe.operators.interval import Bounds, IntervalJoin, band_join, interval_join
from tallyframe.operators.ordered import running_sums


def asof_plain(left, right, backward, equal, within=None):
    out = []
    for k, t, i in left:
        near = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (
            (r[1] == t and equal) or (r[1] < t if backward else r[1] > t))]
        best = max(near, key=lambda r: (r[1] if backward else -r[1], r[2]), default=None)
        if best is not None and within is not None and abs(best[1] - t) > within:
            best = None
        out.append((k, t, i, *(best or (None,) * 3)))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction, equal, within", [
    ("backward", True, None), ("backward", False, None), ("forward", True, None), ("forward", False, 3), ("backward", True, 2)])
def test_asof_equals_the_plain_version(spark, direction, equal, within):
    pick = random.Random(len(direction) + equal)
    key = lambda: pick.choice([None, "a", "a", "hot", "hot", "hot", "z"])
    left = [(key(), pick.choice([None, *range(40)]), n) for n in range(300)]
    right = [(key(), pick.choice([None, *range(40)]), 1000 + n) for n in range(60)] + [("hot", 7, 2000), ("hot", 7, 2001)]
    a = spark.createDataFrame(left, "k string, t int, id bigint").repartition(3)
    b = spark.createDataFrame(right, "k string, t bigint, id bigint").repartition(3)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # state crosses batches too
    try:
        near = None if within is None else F.expr(f"abs(left_time - right_time) <= {within}")
        done = asof_join(a, b, left_on="k", right_on="k", left_time="t", right_time="t", direction=direction,
                         allow_equal=equal, within=near)
        assert done.df.columns == ["k_x", "t_x", "id_x", "k_y", "t_y", "id_y"]
        want = asof_plain(left, right, direction == "backward", equal, within)
        assert sorted(map(tuple, done.df.collect()), key=str) == want
        met = sum(r[3] is not None for r in want)
        report = done.report().first()
        assert (report.left_rows, report.matched_left, report.unmatched_left) == (300, met, 300 - met)
        inner = asof_join(a, b, on="k", left_time="t", right_time="t", direction=direction, allow_equal=equal,
                          within=near, how="inner")
        assert inner.df.columns == ["k", "t_x", "id_x", "t_y", "id_y"] and inner.df.count() == met
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)


def test_asof_carries_one_key_over_many_cells(spark):
    left = spark.range(3000).selectExpr("1 AS k", "id AS t")
    right = spark.createDataFrame([(1, 0, "first"), (1, 2999, "last")], "k int, at bigint, what string")
    met = asof_join(left, right, on="k", left_time="t", right_time="at").df
    assert {r.what: r["count"] for r in met.groupBy("what").count().collect()} == {"first": 2999, "last": 1}
    # a third of the rows under one key, none of whose right rows come first
    late = asof_join(left, right.where("at > 0"), on="k", left_time="t", right_time="at").report().first()
    assert (late.matched_left, late.unmatched_left) == (1, 2999)


def test_asof_of_empty_tables_and_wrong_arguments(spark):
    some = spark.createDataFrame([(1, dt.date(2020, 1, 1), {"a": 1})], "k int, d date, m map<string,int>")
    none = some.limit(0)
    assert asof_join(none, some, on="k", left_time="d", right_time="d").df.count() == 0
    alone = asof_join(some, none, on="k", left_time="d", right_time="d")
    assert [tuple(r) for r in alone.df.collect()] == [(1, dt.date(2020, 1, 1), {"a": 1}, None, None)]
    assert asof_join(none, none, on="k", left_time="d", right_time="d").report().first().left_coverage == 0.0
    with pytest.raises(ValueError, match="one kind"):
        asof_join(some, some, on="k", left_time="d", right_time="k")
    with pytest.raises(ValueError, match="direction"):
        asof_join(some, some, on="k", left_time="d", right_time="d", direction="nearest")


CLOSED = {"both": (True, True), "left": (True, False), "right": (False, True), "neither": (False, False)}


@pytest.mark.parametrize("closed", CLOSED)
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join_equals_the_plain_version(spark, closed, keyed):
    pick = random.Random(len(closed))
    key = lambda: pick.choice([None, "a", "hot", "hot", "z"])
    value = lambda: pick.choice([None, float("nan"), *[float(pick.randint(0, 60)) for _ in range(20)]])
    left = [(key(), value(), n) for n in range(150)]
    right = [(key(), value(), value(), n) for n in range(40)] + [("hot", 0.0, 60.0, 100), ("hot", 5.0, 5.0, 101), (None, 0.0, 9.0, 102)]
    low_in, high_in = CLOSED[closed]
    above, under = (lambda x, lo: x >= lo if low_in else x > lo), (lambda x, hi: x <= hi if high_in else x < hi)
    want = [(i, j) for k, x, i in left for q, lo, hi, j in right if x is not None and lo is not None and hi is not None
            and lo <= hi and above(x, lo) and under(x, hi) and (not keyed or (k is not None and k == q))]
    a = spark.createDataFrame(left, "k string, x double, i int")
    b = spark.createDataFrame(right, "k string, lo double, hi double, j int")
    both = interval_join(a, b, point="x", low="lo", high="hi", closed=closed, **({"on": "k"} if keyed else {}))
    got = both.join()
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    outer = sorted(((r.i, r.j) for r in both.join("left").collect()), key=str)
    assert outer == sorted(want + [(i, None) for _, _, i in left if i not in {w[0] for w in want}], key=str)
    report = both.report().first()
    per_left = {i: sum(w[0] == i for w in want) for i in {w[0] for w in want}}
    per_right = {j: sum(w[1] == j for w in want) for j in {w[1] for w in want}}
    assert report.asDict() == {
        "left_rows": len(left), "right_rows": len(right), "result_rows": len(want),
        "matched_left": len(per_left), "unmatched_left": len(left) - len(per_left),
        "matched_right": len(per_right), "unmatched_right": len(right) - len(per_right),
        "max_left_to_right": max(per_left.values()), "max_right_to_left": max(per_right.values())}


def test_long_intervals_are_stored_on_few_nodes(spark):
    points = spark.range(5000).withColumnRenamed("id", "x")
    spans = spark.createDataFrame([(n, 4999 - n) for n in range(50)], "lo int, hi int")
    both = interval_join(points, spans, point="x", low="lo", high="hi")
    assert both.join().count() == both.report().first().result_rows == sum(5000 - 2 * n for n in range(50))


def test_band_join_of_dates_and_of_nothing(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, n),) for n in range(1, 10)], "d date")
    both = band_join(days, days.withColumnRenamed("d", "e"), left_value="d", right_value="e",
                     below=F.expr("INTERVAL 1 DAY"), above=F.expr("INTERVAL 0 DAY"))
    assert {(r.d - r.e).days for r in both.join().collect()} == {-1, 0} and both.join().count() == 17
    none = days.limit(0)
    empty = band_join(none, none.withColumnRenamed("d", "e"), left_value="d", right_value="e",
                      below=F.expr("INTERVAL 1 DAY"), above=F.expr("INTERVAL 1 DAY"))
    assert empty.join().count() == 0 and empty.join("left").count() == 0
    assert set(empty.report().first().asDict().values()) == {0}
    with pytest.raises(ValueError, match="numbers"):
        IntervalJoin(days, days, F.col("d"), Bounds(F.lit(1), F.lit(2)))


def test_running_sums_cross_cells(spark):
    rows = [(n % 3 or None, n // 6, n) for n in range(400)] + [(7, None, 5)]
    table = spark.createDataFrame(rows, "k int, t int, v int").repartition(5)
    got = {(r.k, r.t, r.v): r.upto for r in running_sums(table, ["k"], ["t"], {"upto": "v"}).collect()}
    first = lambda t: -1 if t is None else t
    assert got == {(k, t, v): sum(c for a, b, c in rows if a == k and first(b) <= first(t)) for k, t, v in rows}


@pytest.mark.parametrize("keyed", [False, True])
def test_pairs_are_dealt_over_tasks_and_hot_nodes_are_split(spark, monkeypatch, keyed):
    monkeypatch.setattr(interval, "TASK_PAIRS", 500)
    pick = random.Random(6)
    left = [(n, pick.choice([1, 2]), pick.choice([5.0, 5.0, pick.uniform(0, 10), None])) for n in range(400)]
    right = [(n, pick.choice([1, 2]), 5.0 if n < 60 else pick.uniform(0, 10)) for n in range(90)]
    a, b = spark.createDataFrame(left, "i int, k int, x double"), spark.createDataFrame(right, "j int, k2 int, y double")
    on = {"left_on": "k", "right_on": "k2"} if keyed else {}
    both = band_join(a, b, left_value="x", right_value="y", below=0.25, above=0.5, **on)
    near = [(i, j) for i, k, x in left for j, m, y in right if x is not None and y - 0.25 <= x <= y + 0.5 and (k == m or not keyed)]
    inner, outer = both.join(), both.join("left")
    assert inner.rdd.getNumPartitions() >= len(near) / 500
    assert sorted((r.i, r.j) for r in inner.collect()) == sorted(near)
    lone = {i for i, _, _ in left} - {i for i, _ in near}
    assert lone and sorted(((r.i, r.j) for r in outer.collect()), key=str) == sorted(near + [(i, None) for i in lone], key=str)


def test_a_left_band_join_writes_rows_and_no_pairs(spark, monkeypatch):
    written, write = [], interval.pin
    monkeypatch.setattr(interval, "pin", lambda df: (written.append(found := write(df)), found)[1])
    a, b = spark.range(300).selectExpr("id", "id % 3 AS x"), spark.range(300).selectExpr("id AS other", "id % 3 AS y")
    both = band_join(a, b, left_value="x", right_value="y", below=0, above=0)
    assert both.join("left").count() == 30_000
    assert max(t.count() for t in written) <= 300
