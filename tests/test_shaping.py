"""Subsets, imputation and deduplication against plain versions and on odd tables."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.dedupe import dedupe
from tallyframe.operators.impute import impute
from tallyframe.operators.subset import chosen, link, subset


def ids(df, column):
    return sorted((r[column] for r in df.select(column).collect()), key=str)


def test_a_subset_keeps_whole_families_and_what_they_refer_to(spark):
    pick = random.Random(5)
    shops = spark.createDataFrame([(n, pick.choice([1, 2, None])) for n in range(20)], "shop int, town int")
    sales = spark.createDataFrame([(n, pick.choice([None, 99, *range(20)]), pick.choice([None, *range(8)])) for n in range(200)],
                                  "sale int, shop int, item int")
    items = spark.createDataFrame([(n, n % 3) for n in range(8)], "item int, maker int")
    towns = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "town int, name string")
    lone = spark.createDataFrame([(1,)], "x int")
    links = [link("sales", "shop", "shops"), link("sales", "item", "items"), link("shops", "town", "towns")]
    part = subset({"shops": shops, "sales": sales, "items": items, "towns": towns, "lone": lone}, links, "shops", F.col("shop") < 4)
    assert ids(part.kept["shops"], "shop") == [0, 1, 2, 3]
    of = [r for r in sales.collect() if r.shop in (0, 1, 2, 3)]
    assert ids(part.kept["sales"], "sale") == sorted((r.sale for r in of), key=str)
    assert set(ids(part.kept["items"], "item")) == {r.item for r in of} - {None}
    assert part.kept["lone"].count() == 0
    audit = {r.link: r for r in part.audit().collect()}
    assert all(r.unresolved == 0 for r in audit.values())
    assert audit["sales(shop) -> shops(shop)"].keys_changed == 0 and audit["sales(item) -> items(item)"].keys_changed is None
    assert {r["table"]: r.n_kept for r in part.rows().collect()}["lone"] == 0


def test_circles_of_links_end(spark):
    # each worker has a boss; departments have a head, who is a worker of any department
    workers = spark.createDataFrame([(n, n // 2 if n else None, n % 5) for n in range(60)], "id int, boss int, dept int")
    depts = spark.createDataFrame([(n, 59 - n) for n in range(5)], "dept int, head int")
    links = [link("workers", "boss", "workers", "id"), link("workers", "dept", "depts"), link("depts", "head", "workers", "id")]
    part = subset({"workers": workers, "depts": depts}, links, "workers", F.col("id") == 37)
    kept, heads = set(ids(part.kept["workers"], "id")), set(ids(part.kept["depts"], "dept"))
    want, todo, need = set(), [37], set()
    while todo:
        n = todo.pop()
        if n not in want:
            want.add(n)
            todo += [] if n == 0 else [n // 2]
            need.add(n % 5)
            todo.append(59 - n % 5)
    assert kept == want and heads == need
    assert all(r.unresolved == 0 for r in part.audit().collect())
    assert len(ids(part.kept["workers"], "id")) == len(kept)


def test_subset_arguments_nulls_and_empty_tables(spark):
    a = spark.createDataFrame([(1, None), (None, 1)], "k int, up int")
    none = a.limit(0)
    part = subset({"a": a, "b": none}, [link("b", "up", "a", "k")], "a", F.col("k") > 0)
    assert part.kept["a"].count() == 1 and part.kept["b"].count() == 0
    assert [r.references for r in part.audit().collect()] == [0]
    with pytest.raises(ValueError, match="no table"):
        subset({"a": a}, [link("b", "up", "a", "k")], "a", F.lit(True))
    with pytest.raises(ValueError, match="lacks"):
        subset({"a": a}, [link("a", "nope", "a", "k")], "a", F.lit(True))
    shares = spark.range(5000).select(chosen(["id"], 20).alias("in")).where("in").count()
    assert 800 < shares < 1200


@pytest.mark.parametrize("rule", ["mean", "median", "mode", "min", "max"])
def test_imputed_values_equal_the_plain_version(spark, rule):
    pick = random.Random(len(rule))
    rows = [(n, pick.choice([None, "hot", "hot", "hot", "a", "b", "empty"]), pick.choice([None, *range(9)])) for n in range(400)]
    rows = [(i, g, None if g == "empty" else v) for i, g, v in rows]
    table = spark.createDataFrame(rows, "id int, `g.x` string, v int").repartition(4)
    groups = defaultdict(list)
    for _, g, v in rows:
        if v is not None:
            groups[g].append(v)
    counted = {g: Counter(v) for g, v in groups.items()}
    plain = {"mean": statistics.mean, "median": statistics.median, "min": min, "max": max}
    value = {g: min(counted[g], key=lambda x: (-counted[g][x], x)) if rule == "mode" else plain[rule](groups[g]) for g in groups}
    done = impute(table, "v", "g.x", rule)
    got = {r.id: r.v for r in done.df.collect()}
    assert got == {i: pytest.approx(value.get(g)) if v is None and g in value else v for i, g, v in rows}
    assert done.df.columns == table.columns
    report = done.report().first()
    missing = sum(v is None for *_, v in rows)
    left = sum(g == "empty" for _, g, _ in rows)
    assert (report.n_rows, report.n_missing, report.n_filled, report.n_left, report.n_groups, report.n_groups_without) == (
        400, missing, missing - left, left, 5, 1)
    assert done.provenance()["n_left"] == left


def test_imputing_without_groups_and_of_nothing(spark):
    table = spark.createDataFrame([(1.0,), (2.0,), (None,), (9.0,), (4.0,)], "v double")
    assert sorted(r.v for r in impute(table, "v").df.collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]
    assert impute(table.limit(0), "v").df.count() == 0
    assert [r.v for r in impute(table.where("v IS NULL"), "v").df.collect()] == [None]
    with pytest.raises(ValueError, match="numbers"):
        impute(table.selectExpr("string(v) AS v"), "v")
    with pytest.raises(ValueError, match="own groups"):
        impute(table, "v", "v")


def _survivor(rows, rules, order):
    ranked = sorted(rows, key=order)
    out = {}
    for column, rule in rules.items():
        values = [r[column] for r in ranked if r[column] is not None]
        count = Counter(values)
        out[column] = None if not values else {
            "first": values[0], "last": values[-1], "min": min(values), "max": max(values),
            "most_frequent": min(count, key=lambda v: (-count[v], v))}[rule]
    return out


def test_survivors_equal_the_plain_version(spark):
    pick = random.Random(12)
    rules = {"at": "min", "a": "first", "b": "last", "c": "max", "d": "most_frequent"}
    maybe = lambda *v: pick.choice([None, *v])
    rows = [{"k": maybe("hot", "hot", "x", "y"), "j": pick.choice([1, 2]), "at": n, "a": maybe(1, 2, 3), "b": maybe("p", "q"),
             "c": maybe(1.5, 2.5), "d": maybe("r", "s", "t")} for n in range(200)]
    schema = "k string, j int, at bigint, a int, b string, c double, d string"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5)
    done = dedupe(table, ["k", "j"], order="-at", rules=rules)
    groups = defaultdict(list)
    for r in rows:
        if r["k"] is not None:
            groups[r["k"], r["j"]].append(r)
    want = [(k, j, *_survivor(g, rules, lambda r: -r["at"]).values()) for (k, j), g in groups.items()]
    want += [tuple(r.values()) for r in rows if r["k"] is None]
    assert sorted(map(tuple, done.df.collect()), key=str) == sorted(want, key=str)
    report = done.report().first()
    alone = sum(r["k"] is None for r in rows)
    assert (report.input_rows, report.result_rows, report.rows_dropped) == (200, len(want), 200 - len(want))
    assert (report.n_null_keys, report.n_keys, report.max_key_multiplicity) == (alone, len(groups), max(map(len, groups.values())))
    assert done.df.count() == report.result_rows
    differ = lambda c: sum(len({r[c] for r in g} - {None}) > 1 for g in groups.values())
    lacks = lambda c: sum(max(g, key=lambda r: r["at"])[c] is None and any(r[c] is not None for r in g) for g in groups.values())
    assert {r["column"]: (r.rule, r.n_conflicts, r.n_filled) for r in done.conflicts().collect()} == {
        c: (rule, differ(c), lacks(c)) for c, rule in rules.items()}
    assert done.provenance()["rows_dropped"] == report.rows_dropped


def test_ties_are_broken_by_contents_wherever_rows_lie(spark):
    rows = [(1, "x", {"a": n}, n) for n in range(30)]
    table = spark.createDataFrame(rows, "k int, s string, m map<string,int>, v int")
    got = [dedupe(table.repartition(n, "v"), "k").df.first() for n in (1, 7)]
    assert got[0] == got[1] and got[0].m["a"] is not None
    same = dedupe(spark.createDataFrame([(1, 2)] * 5, "k int, v int"), "k")
    assert [tuple(r) for r in same.df.collect()] == [(1, 2)] and same.report().first().rows_dropped == 4


def test_dedupe_of_nothing_and_wrong_arguments(spark):
    table = spark.createDataFrame([(1, "a", "b")], "k int, s string, t string")
    empty = dedupe(table.limit(0), "k")
    assert empty.df.count() == 0 and set(empty.report().first().asDict().values()) == {0}
    assert dedupe(table.select("k"), "k").conflicts().count() == 0
    with pytest.raises(ValueError, match="rules"):
        dedupe(table, "k", rules={"s": "best"})
    with pytest.raises(ValueError, match="rules"):
        dedupe(table, "k", rules={"k": "first"})
    with pytest.raises(ValueError, match="lacks"):
        dedupe(table, "z")
    with pytest.raises(ValueError, match="descending"):
        dedupe(table, "k", order="-s")
