"""Post-conditions of produced tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import commas, read, rounded
from tallyframe.operators import outcome as O
from tallyframe.operators.joining import apply_join
from tallyframe.operators.profile import null_rates

GRAIN = ["l_orderkey", "l_linenumber"]


def _labelled(spark, sf_dir):
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return documents, labels, apply_join(documents, labels, how="left", on="doc_id", diagnose=False)


def outcome_nulls(spark, sf_dir):
    """Only columns with nulls are listed."""
    _, _, joined = _labelled(spark, sf_dir)
    return null_rates(joined.df).where(F.col("n_null") > 0).select(
        "name", "n_rows", "n_null", rounded("null_rate"))


def _unrelated(spark, sf_dir):
    """A left join that matches nothing: events against segments by name."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    customer = read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    joined = apply_join(events, customer, how="left", left_on="event_type", right_on="c_mktsegment",
                        diagnose=False)
    report = O.outcome_report(
        joined.df, inputs={"events": events, "customer": customer},
        keys={"events": ["event_type"], "customer": ["c_mktsegment"]},
        mappings={s: {getattr(c, w): c.name for c in joined.columns if getattr(c, w)}
                  for s, w in (("events", "left"), ("customer", "right"))},
    )
    return O.report_frame(spark, report)


def outcome_no_contribution(spark, sf_dir):
    return _unrelated(spark, sf_dir).select(
        "n_rows", commas("newly_all_null_columns").alias("newly_all_null"), commas("flags").alias("flags"),
        commas("blocking").alias("blocking"))


def outcome_contribution(spark, sf_dir):
    documents, labels, joined = _labelled(spark, sf_dir)
    report = O.outcome_report(joined.df, inputs={"documents": documents, "labels": labels},
                              keys={"documents": ["doc_id"], "labels": ["doc_id"]}, grain=["doc_id"])
    return O.report_frame(spark, report).select(
        F.inline("contribution"), "grain_unique", commas("flags").alias("flags"))


def outcome_grain_lineitem(spark, sf_dir):
    return O.grain_check(read(spark, sf_dir, "lineitem"), GRAIN)


def outcome_grain_examples(spark, sf_dir):
    return O.grain_examples(read(spark, sf_dir, "lineitem"), GRAIN)


def outcome_flags_grain(spark, sf_dir):
    lineitem = read(spark, sf_dir, "lineitem")
    report = O.outcome_report(lineitem, inputs={"lineitem": lineitem}, grain=GRAIN)
    return O.report_frame(spark, report).select(
        "n_rows", "n_cols", "empty", "grain_unique", "n_duplicated_keys", "max_multiplicity",
        commas("flags").alias("flags"))


def outcome_flags_empty(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    none = orders.where(F.col("o_totalprice") < 0)
    report = O.outcome_report(none, inputs={"orders": orders}, grain=["o_orderkey"])
    return O.report_frame(spark, report).select("n_rows", "empty", commas("flags").alias("flags"))


QUERIES = {
    "outcome_nulls": outcome_nulls,
    "outcome_no_contribution": outcome_no_contribution,
    "outcome_contribution": outcome_contribution,
    "outcome_grain_lineitem": outcome_grain_lineitem,
    "outcome_grain_examples": outcome_grain_examples,
    "outcome_flags_grain": outcome_flags_grain,
    "outcome_flags_empty": outcome_flags_empty,
}

_GROUPED = "(SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL)"
_LABELLED = "documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id"

ORACLES = {
    "outcome_nulls": f"""SELECT name, n_rows, n_null, round(n_null / n_rows, 6) AS null_rate FROM (
        SELECT 'quality' AS name, count(*) AS n_rows, count(*) - count(quality) AS n_null FROM {_LABELLED}
        UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic) FROM {_LABELLED}) WHERE n_null > 0""",
    "outcome_no_contribution": """SELECT count(*) AS n_rows,
        CASE WHEN count(c_mktsegment) = 0 THEN 'c_mktsegment,c_acctbal' ELSE '' END AS newly_all_null,
        CASE WHEN count(c_acctbal) = 0 THEN 'all_null_column,source_did_not_contribute' ELSE '' END AS flags,
        CASE WHEN count(c_acctbal) = 0 THEN 'all_null_column,source_did_not_contribute' ELSE '' END AS blocking
        FROM events LEFT JOIN customer ON event_type = c_mktsegment""",
    "outcome_contribution": f"""SELECT 'documents' AS name, count(d.text) > 0 AS contributed, 4 AS n_columns,
          count(*) = count(DISTINCT d.doc_id) AS grain_unique,
          CASE WHEN count(*) = count(DISTINCT d.doc_id) THEN '' ELSE 'grain_not_unique' END AS flags FROM {_LABELLED}
        UNION ALL SELECT 'labels', count(quality) + count(toxic) > 0, 2, count(*) = count(DISTINCT d.doc_id),
          CASE WHEN count(*) = count(DISTINCT d.doc_id) THEN '' ELSE 'grain_not_unique' END FROM {_LABELLED}""",
    "outcome_grain_lineitem": f"""SELECT count(*) AS n_distinct, count(*) FILTER (WHERE n_rows > 1) AS n_duplicated_keys,
        max(n_rows) AS max_multiplicity, count(*) FILTER (WHERE n_rows > 1) = 0 AS "unique" FROM {_GROUPED}""",
    "outcome_grain_examples": f"""SELECT * FROM {_GROUPED} WHERE n_rows > 1
        ORDER BY n_rows DESC, l_orderkey, l_linenumber LIMIT 5""",
    "outcome_flags_grain": f"""SELECT (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_cols, false AS empty,
        max(n_rows) = 1 AS grain_unique, count(*) FILTER (WHERE n_rows > 1) AS n_duplicated_keys,
        max(n_rows) AS max_multiplicity, CASE WHEN max(n_rows) > 1 THEN 'grain_not_unique' ELSE '' END AS flags
        FROM {_GROUPED}""",
    "outcome_flags_empty": """SELECT count(*) AS n_rows, count(*) = 0 AS empty,
        CASE WHEN count(*) = 0 THEN 'empty_output' ELSE '' END AS flags FROM orders WHERE o_totalprice < 0""",
}
