import datetime as dt
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_specs import CLEAN, FAN_OUT, MODELS, ONE_PER_DAY, SOURCES

from tallyframe.operators import overlap as O
from tallyframe.plans import graph as G, lineage as L


@pytest.fixture(scope="module")
def tables(bookings, hotels, city_events):
    return {"otb": bookings, "hotels": hotels, "city_events": city_events}


def composed(spark, tables, models):
    steps, depth = L.step_columns(spark, models, tables=tables)
    return steps, L.compose(steps, depth)


def test_the_step_that_changed_a_column_most_explains_it(spark, tables):
    _, found = composed(spark, tables, {"m": {"sources": SOURCES, "steps": [*CLEAN, FAN_OUT]}})
    rows = {(r["column"], r["in_table"], r["in_col"]): (r["via"], r["step"]) for r in found.collect()}
    assert rows["city", "hotels", "city"] == ("normalize", "m#hotels_clean")
    assert rows["city_name", "city_events", "city_name"] == ("normalize", "m#events_clean")
    # carried all the way: the later step explains it
    assert rows["revenue", "otb", "revenue"] == ("join", "m#with_events")
    # a shared key comes from both sides
    assert {t for c, t, _ in rows if c == "hotel_id"} == {"otb", "hotels"}


def test_renamed_columns_and_ties(spark, tables):
    twice = {"m": {"sources": SOURCES, "steps": [
        {"id": "j", "op": "join", "left": "hotels", "right": "hotels", "keys": ["hotel_id"]},
        {"id": "n", "op": "normalize", "input": "j", "transforms": [{"column": "city_x", "op": "lower"}]}]}}
    _, found = composed(spark, tables, twice)
    rows = {r["column"]: (r["in_col"], r["via"], r["step"]) for r in found.collect()}
    assert rows["city_x"] == ("city", "normalize", "m#n")
    assert rows["city_y"] == ("city", "join", "m#j")
    assert found.where("column = 'hotel_id'").count() == 1  # one edge per origin


def test_lineage_restarts_at_an_upstream_model_and_stops_at_sql(spark, tables):
    steps, found = composed(spark, tables, MODELS)
    edges = {(r["model"], r["column"], r["in_kind"], r["in_table"]) for r in found.collect()}
    assert ("twice", "revenue", "model", "stg") in edges
    assert ("twice", "city", "model", "mart") in edges and ("twice", "city", "model", "stg") in edges
    assert not any(m == "mart" for m, *_ in edges)
    last = steps.groupBy("model").agg(F.max("step_pos").alias("step_pos"))
    columns = steps.join(last, ["model", "step_pos"]).select("model", F.col("out_col").alias("column")).distinct()
    unread = {(r["model"], r["column"]) for r in L.unresolved(columns, found).collect()}
    assert unread == {("mart", "city"), ("mart", "r")}


@pytest.fixture(scope="module")
def graph(spark, tables):
    models = {**MODELS, "agg": {"sources": SOURCES, "steps": [CLEAN[0], ONE_PER_DAY]}}
    steps, depth = L.step_columns(spark, models, tables=tables)
    found = L.compose(steps, depth)
    last = steps.groupBy("model").agg(F.max("step_pos").alias("step_pos"))
    columns = steps.join(last, ["model", "step_pos"]).select("model", F.col("out_col").alias("column")).distinct()
    sources = spark.createDataFrame(
        [("otb", "otb", "Bookings.", False, "1:1"), ("hotels", "hotels", "drafted", True, "2:2"),
         ("city_events", "city_events", None, True, None)],
        "name string, path string, summary string, drafted boolean, fingerprint string")
    source_columns = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns],
                                           "source string, name string")
    groups = spark.createDataFrame([("trip", "travel", "otb"), ("trip", "travel", "hotels")],
                                   "group string, context string, source string")
    nodes = G.build_nodes(sources, source_columns, steps.select(F.col("model").alias("name")).distinct(),
                          columns, groups, L.unresolved(columns, found))
    edges = G.build_edges(nodes, steps.select("model", "in_kind", "in_table").distinct(),
                          L.derives_from(found), sources, groups)
    return nodes.cache(), edges.cache()


def test_nodes_and_edges(graph):
    nodes, edges = graph
    counts = {(r["what"], r["kind"]): r["n"] for r in G.kind_counts(nodes, edges).collect()}
    assert counts["node", "Source"] == 3 and counts["node", "Model"] == 4 and counts["node", "Group"] == 1
    assert counts["edge", "IN_GROUP"] == 2 and counts["edge", "HAS_COLUMN"] == counts["node", "Column"]
    assert nodes.where("derivation = 'unknown'").count() == 2 + 3
    assert {r["name"] for r in G.unread_sources(nodes).collect()} == {"hotels", "city_events"}
    assert G.shared_groups(nodes, edges).count() == 2


def test_neighbourhood_and_column_lineage(graph, spark):
    nodes, edges = graph
    overlaps = spark.createDataFrame(
        [("source:otb::hotel_id", "source:hotels::hotel_id", "source:otb", "source:hotels")],
        "src string, dst string, src_table string, dst_table string")
    near = G.table_neighbourhood(nodes, edges, overlaps, "source:otb").collect()
    found = {(r["relation"], r["name"]) for r in near}
    assert found == {("read_by", "stg"), ("group", "trip"), ("overlaps", "hotels")}
    assert {r["member"] for r in near if r["relation"] == "group"} == {"hotels", "otb"}
    hop = {(r["relation"], r["table"], r["column"]) for r in
           G.column_lineage(nodes, edges, "model:stg::city").collect()}
    assert hop == {("derives_from", "hotels", "city"), ("feeds", "twice", "city")}


def test_origins_carry_the_unread_marker(graph, spark):
    nodes, edges = graph
    starts = spark.createDataFrame([("model:twice::city",), ("model:twice::revenue",)], "start string")
    derived = edges.where("kind = 'DERIVES_FROM'")
    rows = G.with_derivation(L.origins(derived, starts), nodes).collect()
    assert {(r["start"], r["origin"], r["hops"], r["derivation"]) for r in rows} == {
        ("model:twice::city", "model:mart::city", 1, "unknown"),
        ("model:twice::city", "source:hotels::city", 2, None),
        ("model:twice::revenue", "source:otb::revenue", 2, None)}


def test_impact_follows_everything_downstream(graph, spark):
    _, edges = graph
    starts = spark.createDataFrame([("source:hotels::city",)], "start string")
    reached = L.impact(edges.where("kind = 'DERIVES_FROM'"), starts)
    assert {(r["node"], r["hops"]) for r in reached.collect()} == {
        ("model:stg::city", 1), ("model:twice::city", 2)}


def test_walks_survive_cycles_and_diamonds(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",)], "start string")
    assert [tuple(r) for r in L.origins(edges, starts).collect()] == [("a", "e", 3)]
    assert {r["node"] for r in L.impact(edges, spark.createDataFrame([("y",)], "start string")).collect()} == {"x"}
    assert L.origins(edges, starts, max_hops=2).count() == 0


def test_long_trails_are_followed_to_their_end(spark):
    chain = spark.range(12).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst")
    starts = spark.createDataFrame([("n0",), ("n9",)], "start string")
    assert {tuple(r) for r in L.origins(chain, starts).collect()} == {("n0", "n12", 12), ("n9", "n12", 3)}


def test_a_large_graph_is_drawn_whole_unless_limited(spark):
    nodes = spark.range(700).selectExpr("concat('model:m', id) AS id", "'Model' AS label", "concat('m', id) AS name")
    edges = spark.range(699).selectExpr("'READS' AS kind", "concat('model:m', id) AS src", "concat('model:m', id + 1) AS dst")
    none = spark.createDataFrame([], "src string, dst string, src_table string, dst_table string")
    assert [f.count() for f in G.subgraph(nodes, edges, none)] == [700, 699]
    assert G.subgraph(nodes, edges, none, cap=600)[0].count() == 600


def test_long_lists_say_what_is_missing(spark):
    nodes = spark.range(30).selectExpr(
        "concat('model:m', id) AS id", "'Model' AS label", "concat('m', id) AS key", "concat('m', id) AS name",
        "CAST(NULL AS STRING) AS table_id")
    edges = spark.range(1, 30).selectExpr("'READS' AS kind", "concat('model:m', id) AS src", "'model:m0' AS dst")
    none = spark.createDataFrame([], "src string, dst string, src_table string, dst_table string")
    assert G.table_neighbourhood(nodes, edges, none, "model:m0").count() == 29
    rows = G.table_neighbourhood(nodes, edges, none, "model:m0", limit=25).collect()
    assert len(rows) == 26
    assert [r["not_shown"] for r in rows if r["not_shown"]] == [4]


# --- overlaps ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def codes(spark):
    return {"a": spark.createDataFrame([("C1", 1), ("C1", 2), ("C2", 3)], "code string, n bigint"),
            "b": spark.createDataFrame([("C1", "x"), ("C2", "x"), ("C3", "x"), ("C4", None)], "code string, t string")}


def pair(lc="code", rc="code", reason="same codes", **more):
    return {"left": "a", "left_column": lc, "right": "b", "right_column": rc, "reason": reason, **more}


def test_overlap_is_not_symmetric(codes):
    row = O.measure_overlaps(codes, [pair()]).first()
    assert (row["n_shared_values"], row["left_coverage"], row["right_coverage"]) == (2, 1.0, 0.5)
    assert row["asked_because"] == "same codes" and row["comparable_types"]


def test_different_types_are_reported_and_nulls_never_match(codes):
    row = O.measure_overlaps(codes, [pair("n", "t")]).first()
    assert (row["n_shared_values"], row["comparable_types"], row["right_n_null"]) == (0, False, 1)
    assert (row["left_type"], row["right_type"]) == ("numeric", "string")


def test_a_pair_needs_its_reason_and_known_ends(codes):
    with pytest.raises(ValueError, match="reason"):
        O.measure_overlaps(codes, [pair(reason=" ")])
    with pytest.raises(ValueError, match="no table"):
        O.measure_overlaps(codes, [pair(left="z")])
    with pytest.raises(ValueError, match="needs left_column"):
        O.measure_overlaps(codes, [pair(lc="")])
    with pytest.raises(ValueError, match="left table lacks"):
        O.measure_overlaps(codes, [pair(lc="zz")])


def kept(spark, codes, prints, when):
    measured = O.measure_overlaps(codes, [pair(), pair("n", "t", "numbers?"), pair("code", "t", "text?")])
    return O.overlap_records(measured, spark.createDataFrame(prints, "table string, fingerprint string"), when)


def test_records_attach_go_stale_and_are_superseded(spark, codes):
    def nodes(a, b):
        rows = [("source:a", "Source", "a", "a", None, a), ("source:b", "Source", "b", "b", None, b)]
        rows += [(f"source:{t}::{c}", "Column", "", c, f"source:{t}", None)
                 for t, df in codes.items() for c in df.columns if c != "t"]
        return spark.createDataFrame(rows, "id string, label string, key string, name string, table_id string, fingerprint string")

    old = kept(spark, codes, [("a", "1"), ("b", "1")], dt.datetime(2026, 1, 1))
    new = kept(spark, codes, [("a", "2"), ("b", None)], dt.datetime(2026, 1, 2))
    both = old.unionByName(new)
    overlaps = G.overlap_edges(both, nodes("2", "1"))
    assert [(r["left_fingerprint"], r["n_shared_values"]) for r in overlaps.collect()] == [("2", 2)]
    assert {r["right_column"] for r in G.unattachable(old, nodes("1", "1")).collect()} == {"t"}

    def stale(records, now):
        return G.with_staleness(G.overlap_edges(records, now), now).first()["stale"]

    assert stale(old, nodes("1", "1")) is False
    assert stale(old, nodes("1", "9")) is True
    assert stale(new, nodes("2", "9")) is None  # the right end was never fingerprinted
    assert stale(new, nodes("9", "9")) is True


def test_a_rebuild_keeps_measured_columns(graph, spark):
    nodes, edges = graph
    overlaps = spark.createDataFrame([("source:otb::hotel_id", "source:hotels::hotel_id")], "src string, dst string")
    smaller = nodes.where("id NOT LIKE 'source:otb%'")
    merged = {r["id"] for r in G.merge_build(nodes, smaller, overlaps).collect()}
    assert "source:otb::hotel_id" in merged and "source:otb::revenue" not in merged


def test_subgraph(graph, spark):
    nodes, edges = graph
    overlaps = spark.createDataFrame(
        [("source:otb::hotel_id", "source:hotels::hotel_id", "source:otb", "source:hotels", 4, True)],
        "src string, dst string, src_table string, dst_table string, n_shared_values bigint, comparable_types boolean")
    shown, drawn = G.subgraph(nodes, edges, overlaps)
    assert shown.where("label = 'Column'").count() == 0
    assert {r["kind"] for r in drawn.collect()} == {"READS", "IN_GROUP", "OVERLAPS"}
    few, within = G.subgraph(nodes, edges, overlaps, columns=True, cap=5)
    ids = {r["id"] for r in few.collect()}
    assert len(ids) == 5 and all({r["src"], r["dst"]} <= ids for r in within.collect())
    assert rows_of(G.actionable_zeros(overlaps)) == [] and G.overlap_rollup(overlaps).count() == 1


def test_origins_equal_a_plain_walk_and_write_a_table_a_hop(spark, monkeypatch):
    pick = random.Random(5)
    pairs = [(f"n{pick.randint(0, 40)}", f"n{pick.randint(0, 60)}") for _ in range(70)] + [(f"t{i}", f"t{i + 1}") for i in range(12)]
    pairs += [(f"s{i}", "t0") for i in range(9)] + [("n1", None), (None, "t3"), *pairs[:5]]
    after = {a: {b for c, b in pairs if c == a} for a, _ in pairs if a}
    written, write = [], L.pin
    monkeypatch.setattr(L, "pin", lambda df: (written.append(df), write(df))[1])
    monkeypatch.setattr(L, "pin_rows", lambda df: (found := L.pin(df), found.count()))

    def plain(start):
        ends, seen, level, hop = {}, {start}, [start] if start in after else [], 0
        while level:
            hop += 1
            reached = {b for a in level for b in after[a]}
            ends |= {(start, b, hop): 0 for b in reached if b not in after and b not in {o for _, o, _ in ends}}
            level = [b for b in reached if b in after and b not in seen]
            seen.update(level)
        return set(ends)

    edges = spark.createDataFrame(pairs, "src string, dst string")
    for starts in (sorted({a for a, _ in pairs if a}), ["t11", "n1", "gone"]):
        table = spark.createDataFrame([(s,) for s in [*starts, starts[0], None]], "start string")
        got = L.origins(edges, table).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == set().union(*map(plain, starts))
    written.clear()
    trail = edges.where("src LIKE 't%' OR src LIKE 's%'")
    assert L.origins(trail, trail.selectExpr("src AS start")).count() == 21
    assert len(written) <= 13 + 3
