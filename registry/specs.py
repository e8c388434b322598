"""Specs, models and what a run measured."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.plans import ctas
from tallyframe.plans.metrics import append_metrics, drift_frame, run_metrics, step_previews
from tallyframe.plans.models import build_models
from tallyframe.plans.spec import run_spec, table_at
from tallyframe.session import prepare, run_dir

_BY_NATION = """SELECT n_name, r_name, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM placed GROUP BY n_name, r_name, o_orderpriority"""

CHAIN = {
    "version": 1,
    "sources": {t: f"{t}.parquet" for t in ("orders", "customer", "nation", "region")},
    "steps": [
        {"id": "clean", "op": "normalize", "input": "orders",
         "transforms": [{"column": "o_orderpriority", "op": "strip"}, {"column": "o_orderpriority", "op": "lower"}]},
        {"id": "bought", "op": "join", "left": "clean", "right": "customer", "left_on": ["o_custkey"],
         "right_on": ["c_custkey"], "how": "left", "grain": ["o_orderkey"]},
        {"id": "located", "op": "join", "left": "bought", "right": "nation", "left_on": ["c_nationkey"],
         "right_on": ["n_nationkey"], "how": "left"},
        {"id": "placed", "op": "join", "left": "located", "right": "region", "left_on": ["n_regionkey"],
         "right_on": ["r_regionkey"], "how": "left", "expect": {"left_dropped": 0, "result_rows": 0}},
        {"id": "by_nation", "op": "sql", "inputs": ["placed"], "sql": _BY_NATION},
    ],
}

MODELS = {
    "stg_orders": {"layer": "staging", "sources": {"orders": "orders.parquet"}, "steps": [CHAIN["steps"][0]]},
    "stg_places": {
        "layer": "staging",
        "sources": {"nation": "nation.parquet", "region": "region.parquet"},
        "steps": [{"id": "places", "op": "join", "left": "nation", "right": "region",
                   "left_on": "n_regionkey", "right_on": "r_regionkey", "how": "inner"}],
    },
    "int_customers": {
        "layer": "intermediate",
        "sources": {"customer": "customer.parquet"},
        "steps": [{"id": "customers", "op": "join", "left": "customer", "right": "stg_places",
                   "left_on": "c_nationkey", "right_on": "n_nationkey", "how": "left"}],
    },
    "mart_revenue": {
        "layer": "mart",
        "steps": [
            {"id": "placed", "op": "join", "left": "stg_orders", "right": "int_customers",
             "left_on": "o_custkey", "right_on": "c_custkey", "how": "left"},
            {"id": "by_nation", "op": "sql", "inputs": ["placed"], "sql": _BY_NATION},
        ],
    },
}


def spec_chain_revenue(spark, sf_dir):
    return run_spec(spark, CHAIN, base_dir=sf_dir, pin_steps=True)[-1].df


def spec_step_table(spark, sf_dir):
    """The table an earlier step produces, to be checked on its own."""
    return table_at(spark, CHAIN, "located", base_dir=sf_dir).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"))


_SHOWN = ("input_rows", "input_rows.left", "input_rows.right", "result_rows", "predicted_rows",
          "n_rows", "relationship", "grain.n_distinct")


def _metrics(spark, sf_dir):
    return run_metrics(spark, "run", "chain", run_spec(spark, CHAIN, base_dir=sf_dir, pin_steps=True))


def spec_metrics(spark, sf_dir):
    kept = _metrics(spark, sf_dir).where(F.col("field").isin(*_SHOWN))
    return kept.select("model", "step", "part", "field", "value")


def spec_drift(spark, sf_dir):
    measured = _metrics(spark, sf_dir).where("part = 'provenance'").select("step", "field", "value")
    expected = [(s["id"], k, str(v)) for s in CHAIN["steps"] for k, v in (s.get("expect") or {}).items()]
    expected = spark.createDataFrame(expected, "step string, field string, value string")
    return drift_frame(expected, measured)


def model_dag_build(spark, sf_dir):
    prepare(spark)
    return build_models(spark, MODELS, base_dir=sf_dir, measure=False)[-1].df


def model_written(spark, sf_dir):
    """The mart as written: every model once, readers reading what was written."""
    prepare(spark)
    out = f"{run_dir(spark)}/models-{uuid.uuid4().hex}"
    return build_models(spark, MODELS, base_dir=sf_dir, out_dir=out)[-1].df


def model_ctas_equal(spark, sf_dir):
    """The compiled SQL of the chain, run as one statement."""
    prepare(spark)
    return ctas.compiled_frame(spark, run_spec(spark, CHAIN, base_dir=sf_dir, measure=False))


def gated_models(spark, sf_dir):
    """One row per model: whether the gate let its table be written, and why not."""
    prepare(spark)
    claimed = {
        "lines": {"sources": {"lineitem": "lineitem.parquet"}, "steps": [
            {"id": "kept", "op": "normalize", "input": "lineitem", "grain": ["l_orderkey", "l_linenumber"],
             "transforms": [{"column": "l_returnflag", "op": "lower"}]}]},
        "acknowledged": {"sources": {"lineitem": "lineitem.parquet"}, "steps": [
            {"id": "kept", "op": "normalize", "input": "lineitem", "grain": ["l_orderkey", "l_linenumber"],
             "acknowledge": ["grain_not_unique"], "transforms": [{"column": "l_returnflag", "op": "lower"}]}]},
    }
    out = f"{run_dir(spark)}/gated-{uuid.uuid4().hex}"
    built = build_models(spark, claimed, base_dir=sf_dir, out_dir=out, gate=True)
    rows = [(m.name, m.path is not None, ",".join(m.refused), m.results[-1].outcome["n_rows"]) for m in built]
    return spark.createDataFrame(rows, "model string, written boolean, refused string, n_rows bigint")


# every op that a step may have beside joins, normalizing and SQL
SHAPED = {
    "sources": {"events": "events.parquet", "customer": "customer.parquet", "orders": "orders.parquet"},
    "steps": [
        {"id": "real", "op": "filter", "input": "events", "where": "event_type <> 'view' AND value > 2"},
        {"id": "dated", "op": "derive", "input": "real", "columns": {
            "day": "to_date(ts)", "at": "ts - INTERVAL 27 YEARS", "value": "IF(event_id % 4 = 0, NULL, round(value, 1))"}},
        {"id": "filled", "op": "impute", "input": "dated", "column": "value", "by": ["event_type"], "rule": "median"},
        {"id": "ordered", "op": "asof", "left": "filled", "right": "orders", "left_on": "user_id", "right_on": "o_custkey",
         "left_time": "at", "right_time": "o_orderdate"},
        {"id": "daily", "op": "dedupe", "input": "ordered", "keys": ["user_id", "day"], "order": ["-ts", "event_id"],
         "rules": {"value": "max"}, "grain": ["user_id", "day"], "expect": {"n_null_keys": 0}},
    ],
}


def spec_shaped(spark, sf_dir):
    return run_spec(spark, SHAPED, base_dir=sf_dir)[-1].df.select(
        "user_id", "day", "event_id", "event_type", "value", "o_custkey", "o_orderdate")


def spec_shaped_metrics(spark, sf_dir):
    found = run_metrics(spark, "run", "shaped", run_spec(spark, SHAPED, base_dir=sf_dir))
    return found.where("part = 'provenance'").where(F.col("field").isin(
        "rows_dropped", "n_missing", "n_filled", "matched_left", "unmatched_left", "n_keys", "n_duplicated_keys")).select(
        "step", "field", "value")


def spec_metrics_kept(spark, sf_dir):
    """Metrics of two runs, one of them written twice, read back."""
    prepare(spark)
    path = f"{run_dir(spark)}/metrics-{uuid.uuid4().hex}"
    results = run_spec(spark, CHAIN, base_dir=sf_dir, upto="bought")
    for run in ("a", "b", "a"):
        append_metrics(run_metrics(spark, run, "chain", results), path)
    kept = spark.read.parquet(path).where("part = 'provenance' AND field IN ('input_rows', 'result_rows', 'left_dropped')")
    return kept.select("run", "model", "step", "field", "value")


def spec_previews(spark, sf_dir):
    """The first rows of a step's table, which its statement puts in order."""
    ranked = {"sources": CHAIN["sources"], "steps": [
        *CHAIN["steps"], {"id": "largest", "op": "sql", "inputs": ["by_nation"],
                          "sql": "SELECT n_name, o_orderpriority, n_orders FROM by_nation ORDER BY n_orders DESC, n_name, o_orderpriority"}]}
    results = run_spec(spark, ranked, base_dir=sf_dir, measure=False)
    return step_previews(spark, "run", "chain", results[-1:]).select("step", "n_rows", "n_cols", "place", "row")


QUERIES = {
    "spec_shaped": spec_shaped,
    "spec_shaped_metrics": spec_shaped_metrics,
    "spec_metrics_kept": spec_metrics_kept,
    "spec_previews": spec_previews,
    "spec_chain_revenue": spec_chain_revenue,
    "spec_step_table": spec_step_table,
    "spec_metrics": spec_metrics,
    "spec_drift": spec_drift,
    "model_dag_build": model_dag_build,
    "model_written": model_written,
    "model_ctas_equal": model_ctas_equal,
    "gated_models": gated_models,
}

_PLACED = """(SELECT * REPLACE (lower(trim(o_orderpriority)) AS o_orderpriority) FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey) AS placed"""
_REVENUE = _BY_NATION.replace("FROM placed", f"FROM {_PLACED}")


def _metric(step, part, field, value):
    return (f"SELECT 'chain' AS model, '{step}' AS step, '{part}' AS part, '{field}' AS field, "
            f"CAST(({value}) AS VARCHAR) AS value")


_N = "SELECT count(*) FROM orders"
_SIZES = {"bought": "customer", "located": "nation", "placed": "region"}

_SHAPED = """
        WITH f AS (SELECT * FROM events WHERE event_type <> 'view' AND value > 2),
        d AS (SELECT * REPLACE (CASE WHEN event_id % 4 > 0 THEN round(value, 1) END AS value), ts::DATE AS day, ts - INTERVAL 27 YEARS AS at FROM f),
        i AS (SELECT * REPLACE (coalesce(value, median(value) OVER (PARTITION BY event_type)) AS value) FROM d),
        o AS (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL),
        a AS (SELECT i.*, o.* FROM i ASOF LEFT JOIN o ON i.user_id = o.o_custkey AND i.at >= o.o_orderdate)"""

ORACLES = {
    "spec_shaped": f"""{_SHAPED}
        SELECT user_id, day, arg_min(event_id, p) AS event_id, arg_min(event_type, p) AS event_type, max(value) AS value,
               arg_min(o_custkey, p) FILTER (o_custkey IS NOT NULL) AS o_custkey, arg_min(o_orderdate, p) FILTER (o_orderdate IS NOT NULL) AS o_orderdate
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id) AS p FROM a) GROUP BY user_id, day""",
    "spec_shaped_metrics": f"""{_SHAPED}, g AS (SELECT count(*) AS n FROM a GROUP BY user_id, day)
        SELECT 'real' AS step, 'rows_dropped' AS field, ((SELECT count(*) FROM events) - (SELECT count(*) FROM f))::VARCHAR AS value
        UNION ALL SELECT 'filled', 'n_missing', (SELECT count(*) FROM d WHERE value IS NULL)::VARCHAR
        UNION ALL SELECT 'filled', 'n_filled', (SELECT count(*) FROM d WHERE value IS NULL)::VARCHAR
        UNION ALL SELECT 'ordered', 'matched_left', (SELECT count(o_custkey) FROM a)::VARCHAR
        UNION ALL SELECT 'ordered', 'unmatched_left', (SELECT count(*) - count(o_custkey) FROM a)::VARCHAR
        UNION ALL SELECT 'daily', 'rows_dropped', (SELECT sum(n) - count(*) FROM g)::BIGINT::VARCHAR
        UNION ALL SELECT 'daily', 'n_keys', (SELECT count(*) FROM g)::VARCHAR
        UNION ALL SELECT 'daily', 'n_duplicated_keys', (SELECT count(*) FROM g WHERE n > 1)::VARCHAR""",
    "spec_metrics_kept": """
        SELECT run, 'chain' AS model, step, field, v::VARCHAR AS value FROM (VALUES ('a'), ('b')) r(run), (
          SELECT 'clean' AS step, 'input_rows' AS field, count(*) AS v FROM orders
          UNION ALL SELECT 'bought', 'result_rows', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
          UNION ALL SELECT 'bought', 'left_dropped', 0)""",
    "spec_previews": f"""
        WITH b AS (SELECT n_name, o_orderpriority, sum(n_orders)::BIGINT AS n_orders FROM ({_REVENUE}) GROUP BY ALL),
        p AS (SELECT n_name, o_orderpriority, n_orders, row_number() OVER (ORDER BY n_orders DESC, n_name, o_orderpriority) AS place FROM b)
        SELECT 'largest' AS step, (SELECT count(*) FROM b) AS n_rows, 3 AS n_cols, place,
               '{{"n_name": "' || n_name || '", "o_orderpriority": "' || o_orderpriority || '", "n_orders": ' || n_orders || '}}' AS row
        FROM p WHERE place <= 15""",
    "spec_chain_revenue": _REVENUE,
    "spec_step_table": """SELECT n_name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "spec_metrics": " UNION ALL ".join([
        _metric("clean", "provenance", "input_rows", _N),
        _metric("clean", "outcome", "n_rows", _N),
        *[_metric(s, part, f, _N) for s in _SIZES for part, f in (
            ("provenance", "input_rows.left"), ("provenance", "result_rows"),
            ("provenance", "predicted_rows"), ("outcome", "n_rows"))],
        *[_metric(s, "provenance", "input_rows.right", f"SELECT count(*) FROM {t}") for s, t in _SIZES.items()],
        *[_metric(s, "provenance", "relationship", "'many:1'") for s in _SIZES],
        _metric("bought", "outcome", "grain.n_distinct", "SELECT count(DISTINCT o_orderkey) FROM orders"),
        _metric("by_nation", "provenance", "result_rows", f"SELECT count(*) FROM ({_REVENUE})"),
        _metric("by_nation", "outcome", "n_rows", f"SELECT count(*) FROM ({_REVENUE})"),
    ]),
    "spec_drift": """SELECT 'placed' AS step, 'result_rows' AS field, '0' AS expected,
        CAST(count(*) AS VARCHAR) AS actual FROM orders""",
    "model_dag_build": _REVENUE,
    "model_written": _REVENUE,
    "model_ctas_equal": _REVENUE,
    "gated_models": """WITH g AS (SELECT max(n) > 1 AS broken, sum(n)::BIGINT AS n_rows FROM (
          SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
        SELECT 'lines' AS model, NOT broken AS written, CASE WHEN broken THEN 'grain_not_unique' ELSE '' END AS refused,
          n_rows FROM g
        UNION ALL SELECT 'acknowledged', true, '', n_rows FROM g""",
}
