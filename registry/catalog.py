"""Catalog facts kept per source column."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import commas, read, rounded
from registry.profiles import COLUMNS, DIRTY_PART, DIRTY_PART_SQL, counts_sql, dirty_part
from tallyframe.operators import catalog as C, profile as P


def _facts(spark, sf_dir):
    return C.column_facts(P.profile(read(spark, sf_dir, "customer")), "customer")


def catalog_facts_customer(spark, sf_dir):
    return _facts(spark, sf_dir).select(
        "source", "position", "name", "inferred", rounded("null_rate"), "n_distinct",
        commas("flags").alias("flags"), rounded("median"), "top_freq",
    )


def catalog_refresh_customer(spark, sf_dir):
    """Re-indexing keeps the roles someone recorded and takes the new facts."""
    facts = _facts(spark, sf_dir)
    recorded = facts.where(F.col("name").endswith("key")).select(
        "source", "name", F.lit("join key").alias("role"), F.lit(-1).alias("n_distinct")
    )
    return C.refresh(facts, recorded).select("source", "name", "role", "n_distinct")


def catalog_watch_outs_part(spark, sf_dir):
    summary = C.source_summary(P.profile(dirty_part(spark, sf_dir)), "part")
    return summary.select(
        "source", "n_rows", "n_cols", commas("candidate_keys").alias("candidate_keys"), "watch_outs"
    )


_CUSTOMER = counts_sql("customer", COLUMNS["customer"])
_DIRTY = counts_sql(DIRTY_PART_SQL, {n: k for n, (_, k) in DIRTY_PART.items()})

QUERIES = {
    "catalog_facts_customer": catalog_facts_customer,
    "catalog_refresh_customer": catalog_refresh_customer,
    "catalog_watch_outs_part": catalog_watch_outs_part,
}

ORACLES = {
    "catalog_facts_customer": f"""
        SELECT 'customer' AS source, position, name, inferred, null_rate, n_distinct, flags, median, top_freq
        FROM ({_CUSTOMER}) LEFT JOIN (
            SELECT 'c_custkey' AS name, round(quantile_cont(c_custkey, 0.5), 6) AS median, NULL AS top_freq FROM customer
            UNION ALL SELECT 'c_nationkey', round(quantile_cont(c_nationkey, 0.5), 6), NULL FROM customer
            UNION ALL SELECT 'c_acctbal', round(quantile_cont(c_acctbal, 0.5), 6), NULL FROM customer
            UNION ALL SELECT 'c_name', NULL, max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_name)
            UNION ALL SELECT 'c_mktsegment', NULL, max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)
        ) USING (name)""",
    "catalog_refresh_customer": f"""
        SELECT 'customer' AS source, name, CASE WHEN name LIKE '%key' THEN 'join key' END AS role, n_distinct
        FROM ({_CUSTOMER})""",
    "catalog_watch_outs_part": f"""
        WITH c AS ({_DIRTY}), f AS (
            SELECT position, name, n_rows, unnest(string_split(flags, ',')) AS flag,
                   generate_subscripts(string_split(flags, ','), 1) AS ord FROM c),
        w AS (SELECT position, name, string_agg(phrase, ', ' ORDER BY ord) AS said FROM f JOIN (VALUES
                ('high_null', 'mostly null'), ('all_null', 'empty'),
                ('numeric_stored_as_text', 'numbers stored as text'),
                ('mixed_types', 'mixed types'), ('constant', 'constant value')) AS p(flag, phrase)
              USING (flag) GROUP BY position, name)
        SELECT 'part' AS source, (SELECT max(n_rows) FROM c) AS n_rows, (SELECT count(*) FROM c) AS n_cols,
               (SELECT string_agg(name, ',' ORDER BY position) FROM f WHERE flag = 'possible_key') AS candidate_keys,
               (SELECT string_agg(name || ' (' || said || ')', '; ' ORDER BY position) FROM w) AS watch_outs""",
}
