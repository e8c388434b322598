"""The graph across builds, and questions to it, over the columns that the tables have."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from registry.common import read, rounded
from registry.specs import MODELS
from tallyframe.operators import overlap as O
from tallyframe.plans import graph as G, lineage as L
from tallyframe.plans.graphstore import GraphStore
from tallyframe.session import pin, run_dir
from tallyframe.sources.files import dataset_facts

_SOURCES = ("orders", "customer", "nation", "region")
_PAIRS = [
    {"left": "orders", "left_column": "o_custkey", "right": "customer", "right_column": "c_custkey", "reason": "who ordered"},
    {"left": "customer", "left_column": "c_custkey", "right": "orders", "right_column": "o_orderkey", "reason": "ids of like range"},
    {"left": "nation", "left_column": "n_regionkey", "right": "region", "right_column": "r_regionkey", "reason": "where nations lie"},
]
# two steps that both change a column, one that renames it, and a join that carries it
_TRAILS = {
    "int_orders": {"layer": "intermediate", "sources": {"orders": "orders.parquet", "customer": "customer.parquet"}, "steps": [
        {"id": "trimmed", "op": "normalize", "input": "orders", "transforms": [
            {"column": "o_orderpriority", "op": "strip"}, {"column": "o_orderstatus", "op": "strip"}]},
        {"id": "lowered", "op": "normalize", "input": "trimmed", "transforms": [{"column": "o_orderpriority", "op": "lower"}]},
        {"id": "owned", "op": "join", "left": "lowered", "right": "customer", "left_on": "o_custkey", "right_on": "c_custkey", "how": "left"},
    ]},
    "int_pairs": {"layer": "intermediate", "sources": {"nation": "nation.parquet"}, "steps": [
        {"id": "twice", "op": "join", "left": "nation", "right": "nation", "keys": "n_regionkey"},
        {"id": "shown", "op": "normalize", "input": "twice", "transforms": [{"column": "n_name_x", "op": "lower"}]},
    ]},
    "mart_counts": {"layer": "mart", "steps": [
        {"id": "counted", "op": "sql", "inputs": ["int_orders"],
         "sql": "SELECT c_mktsegment, count(*) AS n_orders FROM int_orders GROUP BY c_mktsegment"}]},
}


def _parts(spark, sf_dir, tables, models):
    """Nodes and edges from the columns that the tables have, with groups."""
    prints = dataset_facts(spark, {t: f"{sf_dir}/{t}.parquet" for t in tables})
    sources = prints.select(F.col("source").alias("name"), F.concat("source", F.lit(".parquet")).alias("path"), "fingerprint")
    columns = spark.createDataFrame([(t, c) for t in tables for c in read(spark, sf_dir, t).columns], "source string, name string")
    steps, depth = L.step_columns(spark, models, base_dir=sf_dir)
    last = steps.groupBy("model").agg(F.max("step_pos").alias("step_pos"))
    built = pin(steps.join(last, ["model", "step_pos"]).select("model", F.col("out_col").alias("column")).distinct())
    composed = pin(L.compose(steps, depth))
    groups = spark.createDataFrame([("places", "geography", t) for t in ("nation", "region", "customer") if t in tables],
                                   "group string, context string, source string")
    nodes = pin(G.build_nodes(sources, columns, steps.select(F.col("model").alias("name")).distinct(), built, groups=groups,
                              unresolved=L.unresolved(built, composed)))
    edges = pin(G.build_edges(nodes, L.model_reads(spark, models), L.derives_from(composed), sources=sources, groups=groups))
    return nodes, edges


def _overlaps(spark, sf_dir, nodes):
    measured = O.measure_overlaps({t: read(spark, sf_dir, t) for t in _SOURCES}, _PAIRS)
    prints = nodes.where("label = 'Source'").select(
        F.col("name").alias("table"), F.when(F.col("name") == "region", F.lit("before")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return pin(G.overlap_edges(O.overlap_records(measured, prints, dt.datetime(2024, 1, 1)), nodes))


def _rebuilt(spark, sf_dir):
    """Two builds: the second has neither the table of regions nor the models on it."""
    store = GraphStore(spark, f"{run_dir(spark)}/graph-{uuid.uuid4().hex}")
    nodes, edges = _parts(spark, sf_dir, _SOURCES, MODELS)
    store.publish(nodes, edges, "first")
    store.record(_overlaps(spark, sf_dir, nodes))
    store.publish(*_parts(spark, sf_dir, _SOURCES[:3], {"stg_orders": MODELS["stg_orders"]}), "second")
    return store


def graph_rebuild_edges(spark, sf_dir):
    return _rebuilt(spark, sf_dir).edges().select("kind", "src", "dst", "build")


def graph_rebuild_overlaps(spark, sf_dir):
    return _rebuilt(spark, sf_dir).overlaps().select("src", "dst", "n_shared_values")


def _trails(spark, sf_dir):
    return _parts(spark, sf_dir, _SOURCES, _TRAILS)


def lineage_steps(spark, sf_dir):
    """Lineage through several steps, with how many rows each origin's table has."""
    _, edges = _trails(spark, sf_dir)
    sizes = None
    for t in _SOURCES:
        size = read(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
        sizes = size if sizes is None else sizes.unionByName(size)
    table = F.regexp_extract("dst", r"^source:(\w+)\.parquet::", 1)
    return edges.where("kind = 'DERIVES_FROM'").withColumn("table", table).join(sizes, "table").select(
        "src", "dst", "via", "step", "n_rows")


def lineage_unknown(spark, sf_dir):
    nodes, _ = _trails(spark, sf_dir)
    return nodes.where("derivation = 'unknown'").select("id", "name", "derivation")


def lineage_one_hop(spark, sf_dir):
    nodes, edges = _trails(spark, sf_dir)
    return G.column_lineage(nodes, edges, "source:customer.parquet::c_nationkey").select(
        "relation", "label", "table", "column", "via", "step").unionByName(
        G.column_lineage(nodes, edges, "model:int_orders::o_orderpriority").select("relation", "label", "table", "column", "via", "step"))


def graph_neighbourhood(spark, sf_dir):
    nodes, edges = _trails(spark, sf_dir)
    near = G.table_neighbourhood(nodes, edges, _overlaps(spark, sf_dir, nodes), "source:customer.parquet")
    return near.select("relation", "label", "name", "n_measured_pairs", "member")


def overlap_lookup(spark, sf_dir):
    nodes, _ = _trails(spark, sf_dir)
    column = G.find(nodes.where("label = 'Column'"), "source:region.parquet::r_regionkey").first().id
    overlaps = _overlaps(spark, sf_dir, nodes)
    shown = ["other", "direction", "n_shared_values", rounded("own_coverage"), rounded("other_coverage"), "stale"]
    return G.column_overlaps(overlaps, nodes, column).select(*shown).unionByName(
        G.column_overlaps(overlaps, nodes, "source:customer.parquet::c_custkey").select(*shown))


def graph_counts(spark, sf_dir):
    nodes, edges = _trails(spark, sf_dir)
    return G.kind_counts(nodes, edges)


def graph_recipes(spark, sf_dir):
    nodes, edges = _trails(spark, sf_dir)
    unread = G.unread_sources(nodes).select(F.lit("unread").alias("what"), "name", F.lit(None).cast("string").alias("context"))
    return unread.unionByName(G.shared_groups(nodes, edges).select(F.col("group").alias("what"), F.col("source").alias("name"), "context"))


def graph_tables(spark, sf_dir):
    """Tables and groups with the edges among them; measured pairs as one edge a pair of tables."""
    nodes, edges = _trails(spark, sf_dir)
    _, drawn = G.subgraph(nodes, edges, _overlaps(spark, sf_dir, nodes))
    return drawn


QUERIES = {
    "graph_rebuild_nodes": lambda s, d: _rebuilt(s, d).nodes().select("id", "label", "build"),
    "graph_rebuild_edges": graph_rebuild_edges,
    "graph_rebuild_overlaps": graph_rebuild_overlaps,
    "lineage_steps": lineage_steps,
    "lineage_unknown": lineage_unknown,
    "lineage_one_hop": lineage_one_hop,
    "graph_neighbourhood": graph_neighbourhood,
    "overlap_lookup": overlap_lookup,
    "graph_counts": graph_counts,
    "graph_recipes": graph_recipes,
    "graph_tables": graph_tables,
}

# the tables' own columns, as the catalog of the database lists them
_C = """c AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns
              WHERE table_name IN ('orders', 'customer', 'nation', 'region')),
        s AS (SELECT DISTINCT t FROM c)"""


def _shared(left, lc, right, rc):
    return f"(SELECT count(DISTINCT {lc}) FROM {left} WHERE {lc} IN (SELECT {rc} FROM {right}))"


def _cover(left, lc, right, rc):
    return f"(SELECT round(count(*) FILTER ({lc} IN (SELECT {rc} FROM {right})) / count(*), 6) FROM {left})"


_ENDS = [(p["left"], p["left_column"], p["right"], p["right_column"]) for p in _PAIRS]
_STEPS = f"""
        WITH {_C},
        d AS (SELECT 'int_orders' AS m, c AS out, t, c, CASE WHEN c IN ('o_orderpriority', 'o_orderstatus') THEN 'normalize' ELSE 'join' END AS via,
                     CASE c WHEN 'o_orderpriority' THEN 'lowered' WHEN 'o_orderstatus' THEN 'trimmed' ELSE 'owned' END AS step FROM c
              WHERE t IN ('orders', 'customer')
              UNION ALL SELECT 'int_pairs', CASE WHEN c = 'n_regionkey' THEN c ELSE c || side END, t, c,
                     CASE WHEN c || side = 'n_name_x' THEN 'normalize' WHEN c = 'n_regionkey' THEN 'normalize' ELSE 'join' END,
                     CASE WHEN c || side = 'n_name_x' THEN 'shown' WHEN c = 'n_regionkey' THEN 'shown' ELSE 'twice' END
              FROM c, (VALUES ('_x'), ('_y')) v(side) WHERE t = 'nation' AND NOT (c = 'n_regionkey' AND side = '_y'))"""

ORACLES = {
    "graph_rebuild_nodes": f"""
        WITH {_C}
        SELECT 'source:' || t || '.parquet' AS id, 'Source' AS label, 'second' AS build FROM s WHERE t <> 'region'
        UNION ALL SELECT 'source:' || t || '.parquet::' || c, 'Column', 'second' FROM c WHERE t <> 'region'
        UNION ALL SELECT 'source:region.parquet::r_regionkey', 'Column', 'first'
        UNION ALL SELECT 'model:stg_orders', 'Model', 'second'
        UNION ALL SELECT 'model:stg_orders::' || c, 'Column', 'second' FROM c WHERE t = 'orders'
        UNION ALL SELECT 'group:places', 'Group', 'second'""",
    "graph_rebuild_edges": f"""
        WITH {_C}
        SELECT 'HAS_COLUMN' AS kind, 'source:' || t || '.parquet' AS src, 'source:' || t || '.parquet::' || c AS dst, 'second' AS build
        FROM c WHERE t <> 'region'
        UNION ALL SELECT 'HAS_COLUMN', 'model:stg_orders', 'model:stg_orders::' || c, 'second' FROM c WHERE t = 'orders'
        UNION ALL SELECT 'DERIVES_FROM', 'model:stg_orders::' || c, 'source:orders.parquet::' || c, 'second' FROM c WHERE t = 'orders'
        UNION ALL SELECT 'READS', 'model:stg_orders', 'source:orders.parquet', 'second'
        UNION ALL SELECT 'IN_GROUP', 'source:' || t || '.parquet', 'group:places', 'second' FROM s WHERE t IN ('nation', 'customer')""",
    "graph_rebuild_overlaps": " UNION ALL ".join(
        f"SELECT 'source:{a}.parquet::{b}' AS src, 'source:{c}.parquet::{d}' AS dst, {_shared(a, b, c, d)} AS n_shared_values" for a, b, c, d in _ENDS),
    "lineage_steps": f"""{_STEPS}
        SELECT 'model:' || m || '::' || out AS src, 'source:' || t || '.parquet::' || c AS dst, via, m || '#' || step AS step,
               CASE t WHEN 'orders' THEN (SELECT count(*) FROM orders) WHEN 'customer' THEN (SELECT count(*) FROM customer)
                      ELSE (SELECT count(*) FROM nation) END AS n_rows FROM d""",
    "lineage_unknown": """
        SELECT 'model:mart_counts::' || column_name AS id, column_name AS name, 'unknown' AS derivation
        FROM (DESCRIBE SELECT c_mktsegment, count(*) AS n_orders FROM customer GROUP BY ALL)""",
    "lineage_one_hop": f"""{_STEPS}
        SELECT 'feeds' AS relation, 'Model' AS label, m AS "table", out AS "column", via, m || '#' || step AS step FROM d WHERE c = 'c_nationkey'
        UNION ALL SELECT 'derives_from', 'Source', t, c, via, m || '#' || step FROM d WHERE m = 'int_orders' AND out = 'o_orderpriority'""",
    "graph_neighbourhood": f"""
        WITH {_C}
        SELECT 'read_by' AS relation, 'Model' AS label, 'int_orders' AS name, NULL::BIGINT AS n_measured_pairs, NULL AS member
        UNION ALL SELECT 'overlaps', 'Source', 'orders', count(*), NULL FROM c a JOIN c b
          ON (a.t, a.c, b.t, b.c) IN (('orders', 'o_custkey', 'customer', 'c_custkey'), ('customer', 'c_custkey', 'orders', 'o_orderkey'))
        UNION ALL SELECT 'group', 'Group', 'places', NULL, t FROM s WHERE t <> 'orders'""",
    "overlap_lookup": f"""
        SELECT 'source:nation.parquet::n_regionkey' AS other, 'to' AS direction, {_shared('nation', 'n_regionkey', 'region', 'r_regionkey')} AS n_shared_values,
               {_cover('region', 'r_regionkey', 'nation', 'n_regionkey')} AS own_coverage,
               {_cover('nation', 'n_regionkey', 'region', 'r_regionkey')} AS other_coverage, true AS stale
        UNION ALL SELECT 'source:orders.parquet::o_custkey', 'to', {_shared('orders', 'o_custkey', 'customer', 'c_custkey')},
               {_cover('customer', 'c_custkey', 'orders', 'o_custkey')}, {_cover('orders', 'o_custkey', 'customer', 'c_custkey')}, false
        UNION ALL SELECT 'source:orders.parquet::o_orderkey', 'from', {_shared('customer', 'c_custkey', 'orders', 'o_orderkey')},
               {_cover('customer', 'c_custkey', 'orders', 'o_orderkey')}, {_cover('orders', 'o_orderkey', 'customer', 'c_custkey')}, false""",
    "graph_counts": f"""{_STEPS}
        SELECT 'node' AS what, 'Source' AS kind, count(*) AS n FROM s UNION ALL SELECT 'node', 'Model', 3 UNION ALL SELECT 'node', 'Group', 1
        UNION ALL SELECT 'node', 'Column', (SELECT count(*) FROM c) + (SELECT count(*) FROM d) + 2
        UNION ALL SELECT 'edge', 'HAS_COLUMN', (SELECT count(*) FROM c) + (SELECT count(*) FROM d) + 2
        UNION ALL SELECT 'edge', 'DERIVES_FROM', count(*) FROM d UNION ALL SELECT 'edge', 'READS', 4
        UNION ALL SELECT 'edge', 'IN_GROUP', count(*) FROM s WHERE t <> 'orders'""",
    "graph_recipes": f"""
        WITH {_C}
        SELECT 'unread' AS what, t AS name, NULL AS context FROM s
        UNION ALL SELECT 'places', t, 'geography' FROM s WHERE t <> 'orders'""",
    "graph_tables": f"""
        WITH {_C}
        SELECT 'READS' AS kind, 'model:' || m AS src, o AS dst, NULL::BIGINT AS n_measured_pairs FROM (VALUES
          ('int_orders', 'source:orders.parquet'), ('int_orders', 'source:customer.parquet'), ('int_pairs', 'source:nation.parquet'),
          ('mart_counts', 'model:int_orders')) v(m, o)
        UNION ALL SELECT 'IN_GROUP', 'source:' || t || '.parquet', 'group:places', NULL FROM s WHERE t <> 'orders'
        UNION ALL SELECT 'OVERLAPS', 'source:' || a.t || '.parquet', 'source:' || b.t || '.parquet', count(*) FROM c a JOIN c b
          ON (a.t, a.c, b.t, b.c) IN (""" + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _ENDS) + ") GROUP BY a.t, b.t",
}
