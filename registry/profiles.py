"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import commas, read, rounded, sql_flags
from tallyframe.operators import profile as P
from tallyframe.operators.joining import apply_join

# Column kinds of the given tables, as the oracle has to know them.
COLUMNS = {
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string",
               "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer",
                 "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float",
                 "l_discount": "float", "l_tax": "float", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "datetime"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer",
                 "c_acctbal": "float", "c_mktsegment": "string"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string",
             "p_type": "string", "p_size": "integer", "p_retailprice": "float"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "integer"},
    "events": {"event_id": "integer", "ts": "datetime", "user_id": "integer",
               "event_type": "string", "value": "float", "props": "string"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
    "embeddings": {"vec_id": "integer", "embedding": "other", "label": "integer"},
}

# part with the faults a profile looks for, made by one expression per column
DIRTY_PART = {
    "p_partkey": ("p_partkey", "integer"),
    "brand_spaced": ("CASE WHEN p_size % 3 = 0 THEN concat(' ', p_brand) ELSE p_brand END", "string"),
    "size_text": ("CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS {text}) END", "string"),
    "key_text": ("CAST(p_partkey AS {text})", "string"),
    "mostly_null": ("CASE WHEN p_size > 40 THEN p_name END", "string"),
    "never": ("CAST(NULL AS {text})", "string"),
    "fixed": ("'import_v2'", "string"),
    "is_large": ("p_size > 25", "boolean"),
}


def dirty_part(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.selectExpr(*[f"{e.format(text='STRING')} AS {n}" for n, (e, _) in DIRTY_PART.items()])


DIRTY_PART_SQL = "(SELECT {} FROM part)".format(
    ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, (e, _) in DIRTY_PART.items())
)


# --- counts, label and flags ------------------------------------------------------


def _counts(df):
    return P.profile(df).select(
        "position", "name", "inferred", "n_rows", "n_null", rounded("null_rate"), "n_distinct",
        rounded("distinct_rate"), commas("flags").alias("flags"),
    )


def counts_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        text = kind == "string"
        spaced = f"count(*) FILTER (WHERE {c} <> trim({c}))" if text else "0"
        numeric = f"count(*) FILTER (WHERE try_cast({c} AS DOUBLE) IS NOT NULL)" if text else "0"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS kind, count(*) AS n, count({c}) AS p, "
            f"count(DISTINCT {c}) AS d, {spaced} AS w, {numeric} AS x FROM {source}"
        )
    label = (
        "CASE WHEN p = 0 THEN 'empty' WHEN kind NOT IN ('string', 'other') THEN kind "
        "WHEN d / p >= 0.9 THEN 'text' ELSE 'categorical' END"
    )
    flags = sql_flags(
        ("all_null", "p = 0"),
        ("constant", "p > 0 AND d = 1"),
        ("possible_key", "p > 0 AND p = n AND d = n"),
        ("high_null", "p > 0 AND (n - p) / n >= 0.5"),
        ("mixed_types", "kind = 'string' AND x > 0 AND x < p"),
        ("leading_trailing_whitespace", "kind = 'string' AND w > 0"),
        ("numeric_stored_as_text", "kind = 'string' AND p > 0 AND x / p >= 0.9"),
        ("high_cardinality", "kind = 'string' AND p > 0 AND d / p >= 0.9"),
    )
    return (
        f"SELECT position, name, {label} AS inferred, n AS n_rows, n - p AS n_null, "
        "CASE WHEN n > 0 THEN round((n - p) / n, 6) ELSE 0.0 END AS null_rate, d AS n_distinct, "
        f"CASE WHEN p > 0 THEN round(d / p, 6) ELSE 0.0 END AS distinct_rate, {flags} AS flags "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


def _counts_of(table):
    return lambda spark, sf_dir: _counts(read(spark, sf_dir, table))


# --- range, spread and quartiles -----------------------------------------------------


def _numeric(df, **options):
    ranged = P.profile(df, **options).where(F.col("kind").isin("integer", "float"))
    return ranged.select(
        "name", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"),
        rounded("mean", 4), rounded("std", 4), rounded("q25"), rounded("median"), rounded("q75"),
    )


def numeric_sql(table: str) -> str:
    parts = []
    for c, kind in COLUMNS[table].items():
        if kind in ("integer", "float"):
            q = f"quantile_cont({c}, [0.25, 0.5, 0.75])"
            parts.append(
                f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                f"round(CAST({q}[1] AS DOUBLE), 6) AS q25, round(CAST({q}[2] AS DOUBLE), 6) AS median, "
                f"round(CAST({q}[3] AS DOUBLE), 6) AS q75 FROM {table}"
            )
    return " UNION ALL ".join(parts)


def _numeric_of(table, **options):
    return lambda spark, sf_dir: _numeric(read(spark, sf_dir, table), **options)


# --- modal values and samples -----------------------------------------------------------


def _top_of(table):
    def run(spark, sf_dir):
        modal = P.profile(read(spark, sf_dir, table)).where(F.col("top").isNotNull())
        return modal.select("name", "top", "top_freq")

    return run


def top_sql(table: str) -> str:
    parts = [
        f"SELECT '{c}' AS name, CAST(v AS VARCHAR) AS top, n AS top_freq FROM (SELECT {c} AS v, "
        f"count(*) AS n FROM {table} GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"
        for c, kind in COLUMNS[table].items()
        if kind in ("string", "datetime")
    ]
    return " UNION ALL ".join(parts)


def _samples_of(table):
    def run(spark, sf_dir):
        return P.profile(read(spark, sf_dir, table)).select(
            "name", F.posexplode("samples").alias("ord", "sample")
        )

    return run


def samples_sql(table: str) -> str:
    parts = [
        f"SELECT '{c}' AS name, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS ord, "
        f"CAST(v AS VARCHAR) AS sample FROM (SELECT DISTINCT {c} AS v FROM {table} "
        f"WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)"
        for c in COLUMNS[table]
    ]
    return " UNION ALL ".join(parts)


# --- null rates -------------------------------------------------------------------------


def null_rates_documents_labels(spark, sf_dir):
    joined = apply_join(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), how="left", on="doc_id",
        diagnose=False,
    )
    return P.null_rates(joined.df).select("position", "name", "n_rows", "n_null", rounded("null_rate"))


_DOC_LABELS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def candidate_keys_star(spark, sf_dir):
    found = None
    for table in ("region", "nation", "customer", "supplier", "part", "orders"):
        keys = P.candidate_keys(P.profile(read(spark, sf_dir, table)))
        keys = keys.select(F.lit(table).alias("table_name"), "position", "name")
        found = keys if found is None else found.unionByName(keys)
    return found


_STAR = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": list(COLUMNS["customer"]),
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": list(COLUMNS["part"]),
    "orders": list(COLUMNS["orders"]),
}

QUERIES = {
    **{f"profile_counts_{t}": _counts_of(t)
       for t in ("orders", "lineitem", "documents", "customer", "events", "pages", "embeddings")},
    "profile_flags_part_dirty": lambda spark, sf_dir: _counts(dirty_part(spark, sf_dir)),
    **{f"profile_numeric_{t}": _numeric_of(t) for t in ("orders", "part", "lineitem")},
    # the same values by distributed rank search, as tables beyond one task need
    "profile_quartiles_distributed": _numeric_of("orders", quartile_rows=1_000),
    **{f"profile_top_{t}": _top_of(t) for t in ("customer", "events", "documents")},
    **{f"profile_samples_{t}": _samples_of(t) for t in ("customer", "documents", "pages")},
    "null_rates_documents_labels": null_rates_documents_labels,
    "candidate_keys_star": candidate_keys_star,
}

ORACLES = {
    **{f"profile_counts_{t}": counts_sql(t, COLUMNS[t])
       for t in ("orders", "lineitem", "documents", "customer", "events", "pages", "embeddings")},
    "profile_flags_part_dirty": counts_sql(DIRTY_PART_SQL, {n: k for n, (_, k) in DIRTY_PART.items()}),
    **{f"profile_numeric_{t}": numeric_sql(t) for t in ("orders", "part", "lineitem")},
    "profile_quartiles_distributed": numeric_sql("orders"),
    **{f"profile_top_{t}": top_sql(t) for t in ("customer", "events", "documents")},
    **{f"profile_samples_{t}": samples_sql(t) for t in ("customer", "documents", "pages")},
    "null_rates_documents_labels": " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"round((count(*) - count({c})) / count(*), 6) AS null_rate "
        "FROM documents LEFT JOIN labels USING (doc_id)"
        for i, c in enumerate(_DOC_LABELS)
    ),
    "candidate_keys_star": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS name FROM {t} "
        f"HAVING count(DISTINCT {c}) = count(*)"
        for t, columns in _STAR.items()
        for i, c in enumerate(columns)
    ),
}
