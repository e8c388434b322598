"""Key-consistent subsets, imputation by group, and deduplication with counted evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import read
from tallyframe.operators.dedupe import dedupe
from tallyframe.operators.impute import impute
from tallyframe.operators.subset import chosen, link, subset

_LINKS = [
    link("orders", "o_custkey", "customer", "c_custkey"),
    link("lineitem", "l_orderkey", "orders", "o_orderkey"),
    link("lineitem", "l_partkey", "part", "p_partkey"),
    link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    link("customer", "c_nationkey", "nation", "n_nationkey"),
    link("supplier", "s_nationkey", "nation", "n_nationkey"),
    link("nation", "n_regionkey", "region", "r_regionkey"),
]


def _part_of_all(spark, sf_dir):
    names = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")
    return subset({n: read(spark, sf_dir, n) for n in names}, _LINKS, "customer", chosen(["c_custkey"], 4))


def _balances(spark, sf_dir):
    table = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_mktsegment", "IF(c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0, NULL, c_acctbal) AS c_acctbal")
    return impute(table, "c_acctbal", by="c_mktsegment")


def _priorities(spark, sf_dir):
    table = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "IF(o_orderkey % 11 = 0, NULL, o_orderstatus) AS o_orderstatus",
        "IF(o_orderkey % 6 = 0, NULL, o_orderpriority) AS o_orderpriority")
    return impute(table, "o_orderpriority", by="o_orderstatus", rule="mode")


def _quantities(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "IF(l_partkey % 5 = 0, NULL, CAST(l_quantity AS INT)) AS quantity")
    return impute(table, "quantity", by=["l_returnflag", "l_linestatus"], rule="median")


def _users(spark, sf_dir):
    table = read(spark, sf_dir, "events").selectExpr(
        "event_id", "IF(event_id % 50 = 0, NULL, user_id) AS user_id", "ts", "event_type",
        "IF(event_type = 'error', NULL, value) AS value", "props")
    return dedupe(table, "user_id", order=["-ts", "event_id"],
                  rules={"event_type": "most_frequent", "props": "max", "event_id": "min", "ts": "last"})


def _types(spark, sf_dir):
    """Few keys, so that each holds a large share of all events."""
    return dedupe(read(spark, sf_dir, "events"), ["event_type"], order="ts", rules={"user_id": "most_frequent", "value": "max"})


QUERIES = {
    "subset_rows": lambda s, d: _part_of_all(s, d).rows(),
    "subset_audit": lambda s, d: _part_of_all(s, d).audit(),
    "subset_lineitem": lambda s, d: _part_of_all(s, d).kept["lineitem"],
    "subset_supplier": lambda s, d: _part_of_all(s, d).kept["supplier"],
    "impute_median": lambda s, d: _balances(s, d).df,
    "impute_median_hot": lambda s, d: _quantities(s, d).df,
    "impute_mode": lambda s, d: _priorities(s, d).df,
    "impute_report": lambda s, d: _balances(s, d).report().select(F.lit("median").alias("rule"), "*").unionByName(
        _priorities(s, d).report().select(F.lit("mode").alias("rule"), "*")),
    "dedupe_users": lambda s, d: _users(s, d).df,
    "dedupe_types": lambda s, d: _types(s, d).df,
    "dedupe_report": lambda s, d: _users(s, d).report(),
    "dedupe_conflicts": lambda s, d: _users(s, d).conflicts(),
}

_KEPT = """
        c AS (SELECT * FROM customer WHERE ('0x' || md5(c_custkey::VARCHAR)[1:8])::BIGINT % 100 < 4),
        o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
        l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
        p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
        s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
        n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c) OR n_nationkey IN (SELECT s_nationkey FROM s)),
        r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""

_AUDIT = [(each.name, each.child, each.columns[0], each.parent) for each in _LINKS]

_USERS = """u AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN user_id END AS user_id, ts, event_type,
                         CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM u WHERE user_id IS NOT NULL)"""


def _flagged(name: str, key: str = "user_id") -> str:
    """Keys whose rows differ in a column, and keys whose first row lacks what another has."""
    return (f"SELECT '{name}' AS \"column\", count(*) FILTER (d > 1) AS n_conflicts, count(*) FILTER (lacks AND d > 0) AS n_filled FROM "
            f"(SELECT count(DISTINCT {name}) AS d, bool_or(place = 1 AND {name} IS NULL) AS lacks FROM k GROUP BY {key})")



ORACLES = {
    "subset_rows": f"""
        WITH {_KEPT}
        """ + " UNION ALL ".join(f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM {t[0]}) AS n_kept"""
                                 for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")),
    "subset_audit": f"""
        WITH {_KEPT}
        """ + " UNION ALL ".join(f"""SELECT '{name}' AS link, (SELECT count({column}) FROM {child[0]}) AS "references", 0 AS unresolved,
               {'0' if child in ('orders', 'lineitem') and parent in ('customer', 'orders') else 'NULL::BIGINT'} AS keys_changed"""
                                 for name, child, column, parent in _AUDIT),
    "subset_lineitem": f"WITH {_KEPT} SELECT * FROM l",
    "subset_supplier": f"WITH {_KEPT} SELECT * FROM s",
    "impute_median": """
        WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0
                   THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)
        SELECT c_custkey, c_mktsegment, coalesce(c_acctbal, median(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS c_acctbal FROM c""",
    "impute_median_hot": """
        WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
                          CASE WHEN l_partkey % 5 > 0 THEN l_quantity::INT END AS quantity FROM lineitem)
        SELECT l_orderkey, l_linenumber, c.l_returnflag, c.l_linestatus, coalesce(quantity, fill)::DOUBLE AS quantity FROM c
        JOIN (SELECT l_returnflag, l_linestatus, median(quantity) AS fill FROM c GROUP BY ALL) m
        ON c.l_returnflag IS NOT DISTINCT FROM m.l_returnflag AND c.l_linestatus IS NOT DISTINCT FROM m.l_linestatus""",
    "impute_mode": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS o_orderstatus,
                          CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders),
        n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM o WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
        m AS (SELECT o_orderstatus, arg_min(o_orderpriority, (-n, o_orderpriority)) AS fill FROM n GROUP BY ALL)
        SELECT o_orderkey, o.o_orderstatus, coalesce(o_orderpriority, fill) AS o_orderpriority
        FROM o LEFT JOIN m ON o.o_orderstatus IS NOT DISTINCT FROM m.o_orderstatus""",
    "impute_report": """
        WITH c AS (SELECT c_mktsegment AS g, count(*) AS n, count(*) FILTER (c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0) AS m
                   FROM customer GROUP BY ALL),
        o AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS g, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 0) AS m
              FROM orders GROUP BY ALL),
        b AS (SELECT 'median' AS rule, n, m FROM c UNION ALL SELECT 'mode', n, m FROM o)
        SELECT rule, sum(n)::BIGINT AS n_rows, sum(m)::BIGINT AS n_missing, sum(CASE WHEN m < n THEN m ELSE 0 END)::BIGINT AS n_filled,
               sum(CASE WHEN m = n THEN m ELSE 0 END)::BIGINT AS n_left, count(*) AS n_groups, count(*) FILTER (m = n) AS n_groups_without
        FROM b GROUP BY rule""",
    "dedupe_users": f"""
        WITH {_USERS},
        t AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type
              FROM (SELECT user_id, event_type, count(*) AS n FROM k GROUP BY ALL) GROUP BY user_id),
        g AS (SELECT user_id, min(event_id) AS event_id, arg_max(ts, place) AS ts, arg_min(value, place) FILTER (value IS NOT NULL) AS value,
                     max(props) AS props FROM k GROUP BY user_id)
        SELECT event_id, user_id, ts, event_type, value, props FROM g JOIN t USING (user_id)
        UNION ALL SELECT * FROM u WHERE user_id IS NULL""",
    "dedupe_types": """
        WITH t AS (SELECT event_type, arg_min(user_id, (-n, user_id)) AS user_id
                   FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type)
        SELECT arg_min(event_id, ts) AS event_id, min(ts) AS ts, any_value(t.user_id) AS user_id, event_type, max(value) AS value,
               arg_min(props, ts) AS props FROM events JOIN t USING (event_type) GROUP BY event_type""",
    "dedupe_report": f"""
        WITH {_USERS}, g AS (SELECT user_id, count(*) AS n FROM k GROUP BY user_id)
        SELECT (SELECT count(*) FROM u) AS input_rows, (SELECT count(*) FROM g) + (SELECT count(*) FROM u WHERE user_id IS NULL) AS result_rows,
               (SELECT count(*) FROM k) - (SELECT count(*) FROM g) AS rows_dropped, (SELECT count(*) FROM u WHERE user_id IS NULL) AS n_null_keys,
               count(*) AS n_keys, count(*) FILTER (n > 1) AS n_duplicated_keys, max(n) AS max_key_multiplicity FROM g""",
    "dedupe_conflicts": f"""
        WITH {_USERS}
        SELECT "column", CASE "column" WHEN 'event_type' THEN 'most_frequent' WHEN 'props' THEN 'max' WHEN 'event_id' THEN 'min'
               WHEN 'ts' THEN 'last' ELSE 'first' END AS rule, n_conflicts, n_filled
        FROM (""" + " UNION ALL ".join(_flagged(c) for c in ("event_id", "ts", "event_type", "value", "props")) + ")",
}
