"""As-of, interval and band joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import read
from tallyframe.operators.asof import asof_join
from tallyframe.operators.interval import band_join, interval_join


def _events_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    # the events lie after all orders; moved back, they fall among them
    events = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts - INTERVAL 27 YEARS AS ts", "value")
    return asof_join(events, orders, left_on="user_id", right_on="o_custkey", left_time="ts", right_time="o_orderdate")


def _next_purchase(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    later = events.where("event_type = 'purchase'").selectExpr("user_id", "ts AS bought", "event_id AS purchase_id")
    return asof_join(events.select("event_id", "user_id", "ts"), later, on="user_id", left_time="ts", right_time="bought",
                     direction="forward", allow_equal=False, how="inner",
                     within=F.expr("right_time - left_time <= INTERVAL 3 DAYS"))


def _ship_of_flag(spark, sf_dir):
    """Five flags and statuses hold all lines, so each key has a large share of the rows."""
    lines = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey")
    return asof_join(lines, orders, left_on="l_linestatus", right_on="o_orderstatus",
                     left_time="l_shipdate", right_time="o_orderdate")


def _after_errors(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").selectExpr("event_id AS error_id", "user_id", "ts AS since", "ts + INTERVAL 6 HOURS AS until")
    return interval_join(events.select("event_id", "user_id", "ts"), errors, point="ts", low="since", high="until",
                         closed="left", on="user_id")


def _balances(spark, sf_dir):
    return band_join(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"),
                     read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"),
                     left_value="c_acctbal", right_value="s_acctbal", below=25, above=10)


def _local_balances(spark, sf_dir):
    return band_join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"),
                     read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"),
                     left_on="c_nationkey", right_on="s_nationkey",
                     left_value="c_acctbal", right_value="s_acctbal", below=300, above=300)


def _active(spark, sf_dir):
    """Ships inside the years in which a customer ordered: far more pairs than rows."""
    spans = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"))
    return interval_join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), spans,
                         point="l_shipdate", low="since", high="until", closed="right")


def _counted(join):
    return lambda spark, sf_dir: join(spark, sf_dir).report().withColumn("result_rows", F.col("result_rows").cast("bigint"))


QUERIES = {
    "interval_after_errors": lambda s, d: _after_errors(s, d).join(),
    "band_balances": lambda s, d: _balances(s, d).join(),
    "band_balances_left": lambda s, d: _local_balances(s, d).join("left"),
    "interval_report_errors": _counted(_after_errors),
    "band_report_balances": _counted(_local_balances),
    "interval_report_active": _counted(_active),
    "asof_events_orders": lambda s, d: _events_orders(s, d).df,
    "asof_next_purchase": lambda s, d: _next_purchase(s, d).df,
    "asof_hot_status": lambda s, d: _ship_of_flag(s, d).df,
    "asof_report": lambda s, d: _events_orders(s, d).report().withColumn("left_coverage", F.round("left_coverage", 6)),
}

_LAST_ORDER = """(SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
                  FROM orders GROUP BY ALL)"""
_MOVED = "(SELECT event_id, user_id, ts - INTERVAL 27 YEARS AS ts, value FROM events)"

def _report_sql(left: str, right: str, on: str) -> str:
    """Every figure of the report from the join itself."""
    return f"""
        WITH l AS (SELECT *, row_number() OVER () AS li FROM {left}), r AS (SELECT *, row_number() OVER () AS ri FROM {right}),
        j AS (SELECT li, ri FROM l JOIN r ON {on}),
        a AS (SELECT li, count(*) AS n FROM j GROUP BY li), b AS (SELECT ri, count(*) AS n FROM j GROUP BY ri)
        SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM j) AS result_rows,
               (SELECT count(*) FROM a) AS matched_left, (SELECT count(*) FROM l) - (SELECT count(*) FROM a) AS unmatched_left,
               (SELECT count(*) FROM b) AS matched_right, (SELECT count(*) FROM r) - (SELECT count(*) FROM b) AS unmatched_right,
               (SELECT coalesce(max(n), 0) FROM a) AS max_left_to_right, (SELECT coalesce(max(n), 0) FROM b) AS max_right_to_left"""


_ERRORS = "(SELECT event_id AS error_id, user_id, ts AS since, ts + INTERVAL 6 HOURS AS until FROM events WHERE event_type = 'error')"

ORACLES = {
    "interval_after_errors": f"""
        SELECT e.event_id, e.user_id, e.ts, x.error_id, x.since, x.until FROM events e
        JOIN {_ERRORS} x ON e.user_id = x.user_id AND e.ts >= x.since AND e.ts < x.until""",
    "band_balances": """
        SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM customer
        JOIN supplier ON c_acctbal >= s_acctbal - 25 AND c_acctbal <= s_acctbal + 10""",
    "band_balances_left": """
        SELECT c_custkey, c_nationkey, c_acctbal, s_suppkey, s_nationkey, s_acctbal FROM customer
        LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal - 300 AND c_acctbal <= s_acctbal + 300""",
    "interval_report_errors": _report_sql(
        "events", _ERRORS, "l.user_id = r.user_id AND l.ts >= r.since AND l.ts < r.until"),
    "band_report_balances": _report_sql(
        "customer", "supplier", "c_nationkey = s_nationkey AND c_acctbal >= s_acctbal - 300 AND c_acctbal <= s_acctbal + 300"),
    "interval_report_active": """
        WITH s AS (SELECT o_custkey, min(o_orderdate) AS since, max(o_orderdate) AS until FROM orders GROUP BY ALL),
        d AS (SELECT l_shipdate AS x, count(*) AS p FROM lineitem GROUP BY ALL),
        j AS (SELECT x, p, o_custkey FROM d JOIN s ON x > since AND x <= until),
        a AS (SELECT x, any_value(p) AS p, count(*) AS n FROM j GROUP BY x), b AS (SELECT o_custkey, sum(p) AS n FROM j GROUP BY ALL)
        SELECT (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM s) AS right_rows,
               (SELECT sum(p)::BIGINT FROM j) AS result_rows, (SELECT sum(p)::BIGINT FROM a) AS matched_left,
               ((SELECT count(*) FROM lineitem) - (SELECT sum(p) FROM a))::BIGINT AS unmatched_left,
               (SELECT count(*) FROM b) AS matched_right, (SELECT count(*) FROM s) - (SELECT count(*) FROM b) AS unmatched_right,
               (SELECT max(n) FROM a) AS max_left_to_right, (SELECT max(n)::BIGINT FROM b) AS max_right_to_left""",
    "asof_events_orders": f"""
        SELECT e.event_id, e.user_id, e.ts, e.value, o.* FROM {_MOVED} e
        ASOF LEFT JOIN {_LAST_ORDER} o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""",
    "asof_next_purchase": """
        SELECT e.event_id, e.user_id, e.ts, p.bought, p.purchase_id FROM events e
        ASOF JOIN (SELECT user_id, ts AS bought, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
        ON e.user_id = p.user_id AND e.ts < p.bought WHERE p.bought - e.ts <= INTERVAL 3 DAYS""",
    "asof_hot_status": """
        SELECT l_linestatus, l_shipdate, l_orderkey, l_linenumber, o.* FROM lineitem
        ASOF LEFT JOIN (SELECT o_orderstatus, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o
        ON l_linestatus = o_orderstatus AND l_shipdate >= o_orderdate""",
    "asof_report": f"""
        SELECT count(*) AS left_rows, count(o_orderkey) AS matched_left, count(*) - count(o_orderkey) AS unmatched_left,
               round(count(o_orderkey) / count(*), 6) AS left_coverage FROM {_MOVED} e
        ASOF LEFT JOIN {_LAST_ORDER} o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""",
}
