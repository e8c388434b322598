"""All overlaps at once, findings as rows, and drift between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import read, rounded
from registry.specs import CHAIN
from tallyframe.operators.joincheck import JoinCheck
from tallyframe.operators.overlap import all_overlaps
from tallyframe.plans.drift import distribution_drift, drift_classes, value_histograms
from tallyframe.plans.metrics import run_metrics
from tallyframe.plans.spec import run_spec

_TABLES = {
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "f", "o_orderdate": "t", "o_orderpriority": "s"},
    "customer": {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "f", "c_mktsegment": "s"},
    "nation": {"n_nationkey": "n", "n_name": "s", "n_regionkey": "n"},
    "events": {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "f", "props": "s"},
    "lineitem": {"l_orderkey": "n", "l_quantity": "f", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
}


def overlaps_all(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in _TABLES}
    return all_overlaps(tables, {t: list(c) for t, c in _TABLES.items()}).select(
        "left_table", "left_column", "right_table", "right_column", "left_n_rows", "left_n_null", "left_n_distinct",
        "right_n_rows", "right_n_distinct", "n_shared_values", "n_left_only_values", "n_right_only_values",
        rounded("left_coverage"), rounded("right_coverage"))


def _events_check(spark, sf_dir):
    events = read(spark, sf_dir, "events").selectExpr(
        "event_id", "IF(user_id % 7 = 0, NULL, user_id + 40) AS user_id", "event_type")
    customers = read(spark, sf_dir, "customer").where("c_custkey % 5 > 0").selectExpr(
        "c_custkey", "c_name", "IF(c_nationkey = 3, NULL, c_nationkey) AS c_nationkey")
    return JoinCheck(events, customers, left_on="user_id", right_on="c_custkey")


def join_findings_rows(spark, sf_dir):
    check = _events_check(spark, sf_dir)
    return check.evidence().select("evidence", "place", "row", "n_left", "n_right")


def _halves(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 = 1 AND o_orderpriority <> '1-URGENT'")


def drift_distributions(spark, sf_dir):
    before, after = (value_histograms(df) for df in _halves(spark, sf_dir))
    return distribution_drift(before, after).withColumn("distance", F.round("distance", 6))


def drift_of_runs(spark, sf_dir):
    """The same spec over all customers, and over those of the first ten nations."""
    def metrics(run, tables):
        return run_metrics(spark, run, "chain", run_spec(spark, CHAIN, base_dir=sf_dir, tables=tables, pin_steps=True))

    some = read(spark, sf_dir, "customer").where("c_nationkey < 10")
    moved = drift_classes(metrics("a", None), metrics("b", {"customer": some}))
    return moved.where("part = 'provenance' AND step IN ('bought', 'located') AND field IN "
                       "('input_rows.right', 'left_dropped', 'right_dropped', 'relationship', 'result_rows')").select(
        "step", "field", "class", "before", "after", F.round("distance", 6).alias("distance"))


QUERIES = {
    "overlaps_all": overlaps_all,
    "join_findings_rows": join_findings_rows,
    "drift_distributions": drift_distributions,
    "drift_of_runs": drift_of_runs,
}


def _overlaps_sql() -> str:
    flat = [(t, c, k) for t, columns in _TABLES.items() for c, k in columns.items()]
    rows = []
    for j, (rt, rc, rk) in enumerate(flat):
        for lt, lc, lk in flat[:j]:
            if lk == rk or {lk, rk} == {"n", "f"}:
                rows.append(f"""
        SELECT '{lt}' AS left_table, '{lc}' AS left_column, '{rt}' AS right_table, '{rc}' AS right_column,
               (SELECT count(*) FROM {lt}) AS left_n_rows, (SELECT count(*) - count({lc}) FROM {lt}) AS left_n_null,
               (SELECT count(DISTINCT {lc}) FROM {lt}) AS left_n_distinct, (SELECT count(*) FROM {rt}) AS right_n_rows,
               (SELECT count(DISTINCT {rc}) FROM {rt}) AS right_n_distinct, s.n AS n_shared_values,
               (SELECT count(DISTINCT {lc}) FROM {lt}) - s.n AS n_left_only_values,
               (SELECT count(DISTINCT {rc}) FROM {rt}) - s.n AS n_right_only_values,
               (SELECT round(count(*) FILTER ({lc} IN (SELECT {rc} FROM {rt})) / count(*), 6) FROM {lt}) AS left_coverage,
               (SELECT round(count(*) FILTER ({rc} IN (SELECT {lc} FROM {lt})) / count(*), 6) FROM {rt}) AS right_coverage
        FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {lc} AS v FROM {lt}) a JOIN (SELECT DISTINCT {rc} AS v FROM {rt}) b ON a.v = b.v) s""")
    return " UNION ALL ".join(rows)


def _histogram(where: str) -> str:
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM orders WHERE {where} GROUP BY ALL" for c in columns)


_CHECKED = """e AS (SELECT event_id, CASE WHEN user_id % 7 > 0 THEN user_id + 40 END AS user_id, event_type FROM events),
        c AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 5 > 0)"""


def _few(name: str, table: str, where: str, order: str) -> str:
    return (f"SELECT '{name}' AS evidence, place, to_json(t) AS row, NULL::BIGINT AS n_left, NULL::BIGINT AS n_right FROM "
            f"(SELECT {table} AS t, row_number() OVER (ORDER BY {order}) AS place FROM {table} WHERE {where}) WHERE place <= 3")


def _moved(step: str, field: str, before: str, after: str) -> str:
    return (f"SELECT '{step}' AS step, '{field}' AS field, 'measure' AS class, b::VARCHAR AS before, a::VARCHAR AS after, "
            f"round(abs(a - b) / greatest(a, b), 6) AS distance FROM (SELECT ({before}) AS b, ({after}) AS a) WHERE a <> b")


_SOME = "(SELECT * FROM customer WHERE c_nationkey < 10)"
_UNUSED = "SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM orders JOIN {} c ON o_custkey = c_custkey)"
_IDLE = "SELECT count(*) FROM {} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"

ORACLES = {
    "overlaps_all": _overlaps_sql(),
    "join_findings_rows": f"""
        WITH {_CHECKED},
        f AS (SELECT user_id, count(*) AS n FROM e WHERE user_id IN (SELECT c_custkey FROM c) GROUP BY user_id HAVING count(*) > 1),
        g AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS place FROM f)
        {_few('unmatched_left_rows', 'e', 'user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM c)', 'event_id, user_id, event_type')}
        UNION ALL {_few('unmatched_right_rows', 'c', 'c_custkey NOT IN (SELECT user_id FROM e WHERE user_id IS NOT NULL)', 'c_custkey, c_name')}
        UNION ALL {_few('null_key_left_rows', 'e', 'user_id IS NULL', 'event_id')}
        UNION ALL {_few('null_key_right_rows', 'c', 'c_custkey IS NULL', 'c_custkey')}
        UNION ALL SELECT 'fan_out_examples', place, to_json({{'user_id': user_id}}), n, 1 FROM g WHERE place <= 5""",
    "drift_distributions": f"""
        WITH b AS ({_histogram("o_orderkey % 3 = 0")}), a AS ({_histogram("o_orderkey % 3 = 1 AND o_orderpriority <> '1-URGENT'")}),
        m AS (SELECT coalesce(b.c, a.c) AS c, b.n AS b, a.n AS a FROM b FULL JOIN a ON b.c = a.c AND b.v IS NOT DISTINCT FROM a.v),
        t AS (SELECT c, sum(b) AS rb, sum(a) AS ra FROM m GROUP BY c)
        SELECT c AS "column", any_value(rb)::BIGINT AS rows_before, any_value(ra)::BIGINT AS rows_after, count(b) AS values_before,
               count(a) AS values_after, count(*) FILTER (a IS NULL) AS values_gone, count(*) FILTER (b IS NULL) AS values_new,
               coalesce(sum(a) FILTER (b IS NULL), 0)::BIGINT AS rows_new, round(sum(abs(coalesce(b, 0) / rb - coalesce(a, 0) / ra)) / 2, 6) AS distance
        FROM m JOIN t USING (c) GROUP BY c""",
    "drift_of_runs": " UNION ALL ".join([
        _moved("bought", "input_rows.right", "SELECT count(*) FROM customer", f"SELECT count(*) FROM {_SOME}"),
        _moved("bought", "right_dropped", _IDLE.format("customer"), _IDLE.format(_SOME)),
        _moved("located", "right_dropped", _UNUSED.format("customer"), _UNUSED.format(_SOME)),
    ]),
}
