"""Normalize and SQL steps."""

from __future__ import annotations

from registry.common import read
from registry.profiles import DIRTY_PART_SQL, dirty_part
from tallyframe.operators.normalize import apply_normalize
from tallyframe.operators.sqlstep import apply_sql

_SEGMENT = "concat(chr(8195), ' ', upper(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END)"


def _customer(spark, sf_dir):
    segment = _SEGMENT.replace("chr(8195)", "' '")
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", f"{segment} AS segment")


def _normalized(frame, *transforms):
    return lambda spark, sf_dir: apply_normalize(frame(spark, sf_dir), list(transforms)).df


def _t(column, op, **more):
    return {"column": column, "op": op, **more}


_STEPS = (_t("brand_spaced", "strip"), _t("brand_spaced", "lower"), _t("size_text", "to_numeric", fill=-1),
          _t("p_partkey", "to_string"), _t("key_text", "to_numeric"))


def normalize_report(spark, sf_dir):
    return apply_normalize(dirty_part(spark, sf_dir), list(_STEPS)).report()


def normalize_failed_values(spark, sf_dir):
    done = apply_normalize(dirty_part(spark, sf_dir), list(_STEPS))
    return done.failed_values(2)


_DAILY = """SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total,
    count(DISTINCT user_id) AS users FROM events GROUP BY event_type, CAST(ts AS DATE)"""
_RANKED = """WITH spent AS (
      SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spend FROM orders
      JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey)
    SELECT n_name, c_custkey, spend, place FROM (
      SELECT c_nationkey, c_custkey, spend,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY spend DESC, c_custkey) AS place FROM spent) AS r
    JOIN nation ON n_nationkey = c_nationkey WHERE place <= 3"""
_SETS = """SELECT doc_id, 'unlabelled' AS why FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT d.doc_id, 'toxic' AS why FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id WHERE toxic = 1"""
_CUBE = """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"""

_LITERALS = """SELECT event_type, 'load; set' AS mark, count(*) AS force FROM events
    WHERE event_type <> 'copy;' GROUP BY event_type"""


def _sql(statement, *tables):
    return lambda spark, sf_dir: apply_sql({t: read(spark, sf_dir, t) for t in tables}, statement).df


QUERIES = {
    "normalize_strip": _normalized(_customer, _t("segment", "strip")),
    "normalize_lower": _normalized(_customer, _t("segment", "lower")),
    "normalize_chain": _normalized(_customer, _t("segment", "strip"), _t("segment", "lower"), _t("c_name", "lower")),
    "normalize_to_numeric": _normalized(lambda s, d: dirty_part(s, d).select("p_partkey", "size_text"),
                                        _t("size_text", "to_numeric")),
    "normalize_fill": _normalized(lambda s, d: dirty_part(s, d).select("p_partkey", "size_text"),
                                  _t("size_text", "to_numeric", fill=0)),
    "normalize_to_string": _normalized(lambda s, d: dirty_part(s, d).select("p_partkey", "fixed"),
                                       _t("p_partkey", "to_string")),
    "normalize_report": normalize_report,
    "normalize_failed_values": normalize_failed_values,
    "sql_step_agg": _sql(_DAILY, "events"),
    "sql_step_window": _sql(_RANKED, "orders", "customer", "nation"),
    "sql_step_sets": _sql(_SETS, "documents", "labels"),
    "sql_step_grouping_sets": _sql(_CUBE, "orders"),
    "sql_step_literals": _sql(_LITERALS, "events"),
}

_DUCK_CUSTOMER = f"(SELECT c_custkey, c_name, {_SEGMENT} AS segment FROM customer)"


def _row(position, column, op, changed="NULL", converted="NULL", failed="NULL"):
    return (
        f"SELECT count(*) AS input_rows, {position} AS position, '{column}' AS \"column\", '{op}' AS op, "
        f"{changed} AS n_changed, {converted} AS n_converted, {failed} AS n_failed FROM {DIRTY_PART_SQL}"
    )


ORACLES = {
    "normalize_strip": f"SELECT c_custkey, c_name, trim(segment) AS segment FROM {_DUCK_CUSTOMER}",
    "normalize_lower": f"SELECT c_custkey, c_name, lower(segment) AS segment FROM {_DUCK_CUSTOMER}",
    "normalize_chain": f"SELECT c_custkey, lower(c_name) AS c_name, lower(trim(segment)) AS segment FROM {_DUCK_CUSTOMER}",
    "normalize_to_numeric": f"SELECT p_partkey, try_cast(size_text AS DOUBLE) AS size_text FROM {DIRTY_PART_SQL}",
    "normalize_fill": f"SELECT p_partkey, coalesce(try_cast(size_text AS DOUBLE), 0.0) AS size_text FROM {DIRTY_PART_SQL}",
    "normalize_to_string": f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, fixed FROM {DIRTY_PART_SQL}",
    "normalize_report": " UNION ALL ".join([
        _row(0, "brand_spaced", "strip", "count(*) FILTER (WHERE brand_spaced <> trim(brand_spaced))"),
        _row(1, "brand_spaced", "lower", "count(*) FILTER (WHERE trim(brand_spaced) <> lower(trim(brand_spaced)))"),
        _row(2, "size_text", "to_numeric", converted="count(try_cast(size_text AS DOUBLE))",
             failed="count(*) FILTER (WHERE size_text IS NOT NULL AND try_cast(size_text AS DOUBLE) IS NULL)"),
        _row(3, "p_partkey", "to_string", "count(p_partkey)"),
        _row(4, "key_text", "to_numeric", converted="count(try_cast(key_text AS DOUBLE))",
             failed="count(*) FILTER (WHERE key_text IS NOT NULL AND try_cast(key_text AS DOUBLE) IS NULL)"),
    ]),
    "normalize_failed_values": f"""SELECT size_text AS value FROM {DIRTY_PART_SQL}
        WHERE size_text IS NOT NULL AND try_cast(size_text AS DOUBLE) IS NULL ORDER BY 1 LIMIT 5""",
    "sql_step_agg": _DAILY,
    "sql_step_window": _RANKED,
    "sql_step_sets": _SETS,
    "sql_step_grouping_sets": _CUBE,
    "sql_step_literals": _LITERALS,
}
