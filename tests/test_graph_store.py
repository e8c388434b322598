"""Versions of the graph: builds that replace each other, and measurements that stay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import graph as G, lineage as L
from tallyframe.plans.graphstore import GraphStore


def parts(spark, tables):
    sources = spark.createDataFrame([(t, f"{t}.csv") for t in tables], "name string, path string")
    columns = spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "source string, name string")
    none = spark.createDataFrame([], "name string")
    nodes = G.build_nodes(sources, columns, none, spark.createDataFrame([], "model string, column string"))
    derived = spark.createDataFrame([], "kind string, src string, dst string, via string, step string")
    return nodes, G.build_edges(nodes, spark.createDataFrame([], "model string, in_kind string, in_table string"), derived)


def overlap(spark, a, b, n, day):
    return spark.createDataFrame([(a, b, n, 0.5, 0.25, True, "why", dt.datetime(2024, 1, day), None, None, a.split("::")[0], b.split("::")[0])],
                                 "src string, dst string, n_shared_values bigint, left_coverage double, right_coverage double, "
                                 "comparable_types boolean, asked_because string, measured_at timestamp, left_fingerprint string, "
                                 "right_fingerprint string, src_table string, dst_table string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_builds_replace_each_other_and_keep_what_was_measured(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    assert store.current() is None and store.nodes().count() == 0 and store.overlaps() is None
    store.publish(*parts(spark, {"a": ["x", "y"], "b": ["z"]}), "one")
    assert store.current() == "one" and store.edges().count() == 3
    store.record(overlap(spark, "source:a.csv::x", "source:b.csv::z", 1, 1))
    store.record(overlap(spark, "source:a.csv::x", "source:b.csv::z", 7, 2))
    assert [r.n_shared_values for r in store.overlaps().collect()] == [7]
    store.publish(*parts(spark, {"a": ["x"]}), "two")
    kept = {r.id: r.build for r in store.nodes().collect()}
    assert kept == {"source:a.csv": "two", "source:a.csv::x": "two", "source:b.csv::z": "one"}
    assert [r.dst for r in store.edges().collect()] == ["source:a.csv::x"]
    assert store.overlaps().count() == 1 and store.builds() == ["one", "two"]
    store.publish(*parts(spark, {"b": ["z"]}), "three")  # a table comes back: its node is the new build's
    assert {r.id: r.build for r in store.nodes().collect()} == {
        "source:b.csv": "three", "source:b.csv::z": "three", "source:a.csv::x": "two"}
    assert store.builds() == ["three", "two"]


def test_a_failed_build_leaves_the_former_in_use(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    nodes, edges = parts(spark, {"a": ["x"]})
    store.publish(nodes, edges, "good")
    broken = edges.withColumn("src", F.raise_error(F.lit("no such file")).cast("string"))
    with pytest.raises(Exception, match="no such file"):
        store.publish(nodes, broken, "bad")
    with pytest.raises(ValueError, match="more than one node"):
        store.publish(nodes.unionByName(nodes), edges, "doubled")
    with pytest.raises(ValueError, match="in use"):
        store.publish(nodes, edges, "good")
    assert store.current() == "good" and ids(store.nodes()) == ["source:a.csv", "source:a.csv::x"]


def test_one_columns_overlaps_are_told_from_its_side(spark):
    nodes, _ = parts(spark, {"a": ["x"], "b": ["z"]})
    marked = nodes.withColumn("fingerprint", F.when(F.col("id") == "source:a.csv", "now"))
    one = overlap(spark, "source:a.csv::x", "source:b.csv::z", 3, 1).withColumn("left_fingerprint", F.lit("then"))
    (row,) = G.column_overlaps(one, marked, "source:b.csv::z").collect()
    assert (row.other, row.direction, row.own_coverage, row.other_coverage, row.stale) == ("source:a.csv::x", "to", 0.25, 0.5, True)
    (row,) = G.column_overlaps(one.withColumn("left_fingerprint", F.lit(None).cast("string")), marked, "source:a.csv::x").collect()
    assert (row.direction, row.own_coverage, row.stale) == ("from", 0.5, None)
    assert ids(G.find(nodes, "x")) == ids(G.find(nodes, "source:a.csv::x")) == ["source:a.csv::x"]
    assert ids(G.find(nodes, "a.csv")) == ["source:a.csv"] and G.find(nodes, "nothing").count() == 0


def test_models_read_their_declared_inputs_even_through_sql(spark):
    models = {"m": {"sources": {"a": "a.csv"}, "steps": [{"id": "s", "op": "sql", "inputs": ["a", "n"], "sql": "SELECT 1"},
                                                         {"id": "t", "op": "sql", "inputs": ["s"], "sql": "SELECT 1"}]}}
    assert sorted(map(tuple, L.model_reads(spark, models).collect())) == [("m", "model", "n"), ("m", "source", "a.csv")]
    assert L.model_reads(spark, {}).count() == 0
