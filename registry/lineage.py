"""Lineage edges, walks over edges that Spark derives from the tables, and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from registry.common import commas, read, rounded
from registry.specs import MODELS
from tallyframe.operators import catalog as C, overlap as O, profile as P
from tallyframe.plans import graph as G, lineage as L
from tallyframe.session import pin
from tallyframe.sources.files import dataset_facts

TABLES = ("orders", "customer", "nation", "region")


def _graph(spark, sf_dir, measured: bool):
    """Nodes and edges of the model project; source columns carry measured facts."""
    frames = {t: read(spark, sf_dir, t) for t in TABLES}
    sources = spark.createDataFrame([(t, f"{t}.parquet") for t in TABLES], "name string, path string")
    if measured:
        facts = [C.column_facts(P.profile(df), t) for t, df in frames.items()]
        columns = reduce(DataFrame.unionByName, facts)
    else:
        columns = spark.createDataFrame(
            [(t, c) for t, df in frames.items() for c in df.columns], "source string, name string")
    steps, depth = L.step_columns(spark, MODELS, base_dir=sf_dir)
    last = steps.groupBy("model").agg(F.max("step_pos").alias("step_pos"))
    model_columns = steps.join(last, ["model", "step_pos"]).select(
        "model", F.col("out_col").alias("column")).distinct()
    composed = L.compose(steps, depth)
    reads = L.model_reads(spark, MODELS)
    models = steps.select(F.col("model").alias("name")).distinct()
    nodes = pin(G.build_nodes(sources, columns, models, model_columns,
                              unresolved=L.unresolved(model_columns, composed)))
    edges = G.build_edges(nodes, reads, L.derives_from(composed))
    return nodes, edges


def lineage_edges(spark, sf_dir):
    """Each derived column with what was measured of the column it came from."""
    nodes, edges = _graph(spark, sf_dir, measured=True)
    facts = nodes.select(F.col("id").alias("dst"), "inferred", "n_distinct")
    return edges.where("kind = 'DERIVES_FROM'").join(facts, "dst").where(
        F.col("n_distinct").isNotNull()).select("src", "dst", "via", "step", "inferred", "n_distinct")


def graph_column_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir, measured=True)
    own = nodes.where("label = 'Column' AND table_id LIKE 'source:%'")
    return own.select("id", "name", "inferred", rounded("null_rate"), "n_distinct", commas("flags").alias("flags"))


# --- walks over rows as lineage ---------------------------------------------------
# An order comes from its customer and the parts on its lines, a customer from a
# nation, a nation from a region: the edges grow with the tables.


def row_edges(spark, sf_dir, parts: bool = True) -> DataFrame:
    def edge(table, label, key, to, target):
        return read(spark, sf_dir, table).select(
            F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("src"),
            F.concat(F.lit(f"{to}:"), F.col(target).cast("string")).alias("dst"))

    edges = (
        edge("orders", "order", "o_orderkey", "customer", "o_custkey")
        .unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    )
    return edges.unionByName(edge("lineitem", "order", "l_orderkey", "part", "l_partkey")) if parts else edges


def lineage_origins(spark, sf_dir):
    edges = row_edges(spark, sf_dir)
    starts = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("start"))
    return L.origins(edges, starts)


def lineage_impact(spark, sf_dir):
    starts = read(spark, sf_dir, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start"))
    return L.impact(row_edges(spark, sf_dir), starts)


def lineage_origins_deep(spark, sf_dir):
    """Every line of an order comes from the line before it, the first from the order: trails of up to ten hops."""
    lines = read(spark, sf_dir, "lineitem")
    line = lambda n: F.concat_ws(":", F.lit("line"), F.col("l_orderkey").cast("string"), n.cast("string"))
    # the numbers from 1 to any of an order's lines are those to its least and to its greatest
    ends = lines.groupBy("l_orderkey").agg(*[f("l_linenumber").cast("int").alias(n) for n, f in (("least", F.min), ("most", F.max))])
    each = ends.select("l_orderkey", F.explode(F.array_union(*[F.sequence(F.lit(1), n) for n in ("least", "most")])).alias("n"))
    chain = each.select(line(F.col("n")).alias("src"), F.when(F.col("n") > 1, line(F.col("n") - 1)).otherwise(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))).alias("dst"))
    above = row_edges(spark, sf_dir, parts=False).where("dst IS NOT NULL")
    starts = lines.select(line(F.col("l_linenumber").cast("int")).alias("start"))
    return L.origins(chain.unionByName(above), starts)


# --- measured overlaps --------------------------------------------------------------

_PAIRS = [
    {"left": "events", "left_column": "user_id", "right": "customer", "right_column": "c_custkey",
     "reason": "users may be customers"},
    {"left": "events", "left_column": "event_type", "right": "customer", "right_column": "c_mktsegment",
     "reason": "both are small vocabularies"},
    {"left": "events", "left_column": "event_id", "right": "customer", "right_column": "c_custkey",
     "reason": "ids of like range"},
    {"left": "customer", "left_column": "c_name", "right": "supplier", "right_column": "s_suppkey",
     "reason": "names may hold keys"},
    {"left": "customer", "left_column": "c_nationkey", "right": "supplier", "right_column": "s_nationkey",
     "reason": "both refer to nations"},
    {"left": "documents", "left_column": "doc_id", "right": "labels", "right_column": "doc_id",
     "reason": "labels describe documents"},
]
_MEASURED = ("events", "customer", "supplier", "documents", "labels")


def _measured(spark, sf_dir):
    return O.measure_overlaps({t: read(spark, sf_dir, t) for t in _MEASURED}, _PAIRS)


def measured_overlaps(spark, sf_dir):
    return _measured(spark, sf_dir).select(
        "left_table", "left_column", "right_table", "right_column", "n_shared_values",
        rounded("left_coverage"), rounded("right_coverage"), "comparable_types", "asked_because")


def _table_nodes(spark, sf_dir, tables=_MEASURED):
    """Tables and columns as nodes; fingerprints are those of the files as they are now."""
    frames = {t: read(spark, sf_dir, t) for t in tables}
    facts = dataset_facts(spark, {t: f"{sf_dir}/{t}.parquet" for t in tables})
    sources = facts.select(F.col("source").alias("name"), F.concat("source", F.lit(".parquet")).alias("path"),
                           "fingerprint")
    columns = spark.createDataFrame([(t, c) for t, df in frames.items() for c in df.columns],
                                    "source string, name string")
    models = spark.createDataFrame([], "name string")
    built = spark.createDataFrame([], "model string, column string")
    return pin(G.build_nodes(sources, columns, models, built))


def _kept(spark, sf_dir, nodes):
    """Overlaps on the graph, measured when `customer` looked different."""
    prints = nodes.where("label = 'Source'").select(
        F.col("name").alias("table"),
        F.when(F.col("name") == "customer", F.lit("before")).when(F.col("name") != "labels", F.col("fingerprint"))
        .alias("fingerprint"))
    records = pin(O.overlap_records(_measured(spark, sf_dir), prints))
    return records, pin(G.overlap_edges(records, nodes))


def overlap_rollup(spark, sf_dir):
    _, overlaps = _kept(spark, sf_dir, _table_nodes(spark, sf_dir))
    return G.overlap_rollup(overlaps)


def overlap_stale(spark, sf_dir):
    nodes = _table_nodes(spark, sf_dir)
    _, overlaps = _kept(spark, sf_dir, nodes)
    return G.with_staleness(overlaps, nodes).select("src", "dst", "n_shared_values", "stale")


def actionable_zeros(spark, sf_dir):
    _, overlaps = _kept(spark, sf_dir, _table_nodes(spark, sf_dir))
    return G.actionable_zeros(overlaps).select("src", "dst", "asked_because")


def overlap_unattachable(spark, sf_dir):
    """Pairs measured on a table the graph does not hold are named, not dropped."""
    nodes = _table_nodes(spark, sf_dir, ("events", "customer"))
    records, _ = _kept(spark, sf_dir, nodes)
    return G.unattachable(records, nodes).select(
        "left_table", "left_column", "right_table", "right_column", "n_shared_values", "left_known", "right_known")


def table_neighbourhood(spark, sf_dir):
    nodes = _table_nodes(spark, sf_dir)
    _, overlaps = _kept(spark, sf_dir, nodes)
    edges = spark.createDataFrame([], "kind string, src string, dst string, via string, step string")
    near = G.table_neighbourhood(nodes, edges, overlaps, "source:customer.parquet")
    return near.select("relation", "label", "name", "n_measured_pairs")


QUERIES = {
    "lineage_edges": lineage_edges,
    "graph_column_nodes": graph_column_nodes,
    "lineage_origins": lineage_origins,
    "lineage_impact": lineage_impact,
    "lineage_origins_deep": lineage_origins_deep,
    "measured_overlaps": measured_overlaps,
    "overlap_rollup": overlap_rollup,
    "overlap_stale": overlap_stale,
    "actionable_zeros": actionable_zeros,
    "overlap_unattachable": overlap_unattachable,
    "table_neighbourhood": table_neighbourhood,
}

_COLUMNS = {
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string",
               "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
                 "c_mktsegment": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "region": {"r_regionkey": "integer", "r_name": "string"},
}
# model, column, origin table, origin column, op, step
_DERIVED = (
    [("stg_orders", c, "orders", c, "normalize", "stg_orders#clean") for c in _COLUMNS["orders"]]
    + [("stg_places", c, t, c, "join", "stg_places#places") for t in ("nation", "region") for c in _COLUMNS[t]]
    + [("int_customers", c, "customer", c, "join", "int_customers#customers") for c in _COLUMNS["customer"]]
)


def _derived_sql():
    parts = []
    for model, c, table, origin, op, step in _DERIVED:
        kind = _COLUMNS[table][origin]
        label = f"'{kind}'" if kind != "string" else (
            f"CASE WHEN count(DISTINCT {origin}) / count({origin}) >= 0.9 THEN 'text' ELSE 'categorical' END")
        parts.append(
            f"SELECT 'model:{model}::{c}' AS src, 'source:{table}.parquet::{origin}' AS dst, '{op}' AS via, "
            f"'{step}' AS step, {label} AS inferred, count(DISTINCT {origin}) AS n_distinct FROM {table}")
    return " UNION ALL ".join(parts)


def _nodes_sql():
    from registry.profiles import counts_sql

    return " UNION ALL ".join(
        f"SELECT 'source:{t}.parquet::' || name AS id, name, inferred, null_rate, n_distinct, flags "
        f"FROM ({counts_sql(t, columns)})" for t, columns in _COLUMNS.items())


_TEXT_PAIR = 3  # name against number: compared as text


def _overlap_rows(select, keep=lambda i, p: True):
    rows = []
    for i, p in enumerate(_PAIRS):
        if keep(i, p):
            cast = (lambda c: f"CAST({c} AS VARCHAR)") if i == _TEXT_PAIR else (lambda c: c)
            lc, rc = cast(p["left_column"]), cast(p["right_column"])
            shared = (f"(SELECT count(*) FROM (SELECT DISTINCT {lc} AS v FROM {p['left']}) AS a JOIN "
                      f"(SELECT DISTINCT {rc} AS v FROM {p['right']}) AS b ON a.v = b.v)")
            cover = lambda a, b, ca, cb: (
                f"(SELECT round(count(*) FILTER (WHERE {ca} IN (SELECT {cb} FROM {b})) / count(*), 6) FROM {a})")
            rows.append("SELECT " + select(i, p, shared, cover(p["left"], p["right"], lc, rc),
                                           cover(p["right"], p["left"], rc, lc)))
    return " UNION ALL ".join(rows)


_end = lambda p, s: f"'source:{p[s]}.parquet::{p[s + '_column']}'"
# customer changed since, labels was never fingerprinted
_stale = lambda p: "true" if "customer" in (p["left"], p["right"]) else "NULL::BOOLEAN"

ORACLES = {
    "lineage_edges": _derived_sql(),
    "graph_column_nodes": _nodes_sql(),
    "lineage_origins": """
        SELECT 'order:' || o_orderkey AS start, 'region:' || n_regionkey AS origin, 3 AS hops FROM orders
          JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 1 FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 1 FROM orders
          WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "lineage_impact": """
        WITH r AS (SELECT r_regionkey FROM region),
        n AS (SELECT n_nationkey FROM nation JOIN r ON n_regionkey = r_regionkey),
        c AS (SELECT c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey)
        SELECT 'nation:' || n_nationkey AS node, 1 AS hops FROM n
        UNION ALL SELECT 'customer:' || c_custkey, 2 FROM c
        UNION ALL SELECT 'order:' || o_orderkey, 3 FROM orders JOIN c ON o_custkey = c_custkey""",
    "lineage_origins_deep": """
        SELECT DISTINCT 'line:' || l_orderkey || ':' || l_linenumber AS start,
            CASE WHEN n_regionkey IS NOT NULL THEN 'region:' || n_regionkey WHEN c_nationkey IS NOT NULL THEN 'nation:' || c_nationkey
                 WHEN o_custkey IS NOT NULL THEN 'customer:' || o_custkey ELSE 'order:' || l_orderkey END AS origin,
            (l_linenumber + CASE WHEN n_regionkey IS NOT NULL THEN 3 WHEN c_nationkey IS NOT NULL THEN 2
                 WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END)::INT AS hops
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "measured_overlaps": _overlap_rows(lambda i, p, n, a, b: (
        f"'{p['left']}' AS left_table, '{p['left_column']}' AS left_column, '{p['right']}' AS right_table, "
        f"'{p['right_column']}' AS right_column, {n} AS n_shared_values, {a} AS left_coverage, {b} AS right_coverage, "
        f"{'false' if i == _TEXT_PAIR else 'true'} AS comparable_types, '{p['reason']}' AS asked_because")),
    "overlap_rollup": "SELECT src_table, dst_table, count(*) AS n_measured_pairs FROM (" + _overlap_rows(lambda i, p, n, a, b: (
        f"'source:{p['left']}.parquet' AS src_table, 'source:{p['right']}.parquet' AS dst_table, {n} AS n")) + ") GROUP BY ALL",
    "overlap_stale": _overlap_rows(lambda i, p, n, a, b: (
        f"{_end(p, 'left')} AS src, {_end(p, 'right')} AS dst, {n} AS n_shared_values, {_stale(p)} AS stale")),
    "actionable_zeros": "SELECT src, dst, asked_because FROM (" + _overlap_rows(lambda i, p, n, a, b: (
        f"{_end(p, 'left')} AS src, {_end(p, 'right')} AS dst, '{p['reason']}' AS asked_because, {n} AS n"),
        keep=lambda i, p: i != _TEXT_PAIR) + ") WHERE n = 0",
    "overlap_unattachable": _overlap_rows(lambda i, p, n, a, b: (
        f"'{p['left']}' AS left_table, '{p['left_column']}' AS left_column, '{p['right']}' AS right_table, "
        f"'{p['right_column']}' AS right_column, {n} AS n_shared_values, "
        f"{'true' if p['left'] in ('events', 'customer') else 'false'} AS left_known, "
        f"{'true' if p['right'] in ('events', 'customer') else 'false'} AS right_known"),
        keep=lambda i, p: not {p["left"], p["right"]} <= {"events", "customer"}),
    "table_neighbourhood": """SELECT 'overlaps' AS relation, 'Source' AS label, name, n AS n_measured_pairs
        FROM (VALUES ('events', 3), ('supplier', 2)) AS v(name, n)""",
}
