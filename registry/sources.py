"""Files: typed CSV and sinks, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.common import commas, read, rounded
from tallyframe.operators.fileprofile import FileProfiles
from tallyframe.session import prepare, run_dir, small_frame
from tallyframe.sources import files, readers, table, writers


def _scratch(spark, name: str) -> str:
    """A new path in the folder every executor can reach."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_typed(spark, sf_dir):
    """A table written as CSV with missing-value texts, read back with its types found."""
    events = read(spark, sf_dir, "events")
    dirty = events.select(
        "event_id", "ts", "event_type",
        F.when(F.col("user_id") % 5 == 0, "N/A").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("user_id") % 7 == 0, "null").otherwise(F.col("value").cast("string")).alias("value"),
        F.to_date("ts").alias("day"), (F.col("value") > 10).alias("large"), "props",
    )
    path = writers.write_table(dirty, _scratch(spark, "events") + ".csv")
    return readers.load_table(spark, path)


def parquet_sink(spark, sf_dir):
    path = writers.write_output(read(spark, sf_dir, "part"), _scratch(spark, "out"), "part")
    return readers.load_table(spark, path)


def csv_profile(spark, sf_dir):
    """A CSV parsed once and profiled."""
    path = writers.write_table(read(spark, sf_dir, "customer"), _scratch(spark, "customer") + ".csv")
    return readers.profile_path(spark, path).select("name", "dtype", "n_rows", "n_null", "n_distinct")


_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def files_found(spark, sf_dir):
    """The data files of a folder, with the columns of each, which reads no rows."""
    prepare(spark)
    found = {files.stem_of(path): path for path in files.find_data_files(spark, sf_dir)}
    rows = [(name, n + 1, column, kind) for name in _TABLES if name in found
            for n, (column, kind) in enumerate(table.schema_of(readers.load_table(spark, found[name])).items())]
    return small_frame(spark, rows, "name string, position int, column string, type string").drop("type")


def table_measures(spark, sf_dir):
    """Several aggregates of one pass, one of its own, and a derived table's."""
    lines = read(spark, sf_dir, "lineitem")
    found = table.measure(lines, {"n": "count(*)", "least": "min(l_quantity)", "flags": "count(DISTINCT l_returnflag)"})
    paid = table.derive(lines, "l_orderkey", "l_extendedprice * (1 - l_discount) AS paid")
    row = (found["n"], found["least"], found["flags"], table.scalar(lines, "max(l_shipdate)"), table.scalar(paid, "round(max(paid), 4)"),
           len(table.measure(lines, {})))
    return small_frame(spark, [row], "n bigint, least double, flags bigint, latest timestamp_ntz, most_paid double, nothing int")


def table_preview(spark, sf_dir):
    """The first rows in an order, with the table's true size, as rows."""
    shown = table.preview(read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus"), 7, 2)
    rows = table.from_rows(spark, [(n, r["o_orderkey"], r["o_custkey"]) for n, r in enumerate(shown["rows"])],
                           "place int, o_orderkey bigint, o_custkey bigint")
    rows.createOrReplaceTempView("previewed")
    named = table.from_name(spark, "previewed").select("*", F.lit(shown["n_rows"]).cast("bigint").alias("n_rows"), F.lit(shown["n_cols"]).alias("n_cols"))
    spark.catalog.dropTempView("previewed")
    return named


def files_stale(spark, sf_dir):
    """Which tables' files are others than when they were recorded: one was smaller then, one is gone, one makes no claim."""
    now = files.dataset_facts(spark, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES})
    recorded = now.select("source", F.when(F.col("source") == "orders", F.col("size") - 1).when(
        F.col("source") != "part", F.col("size")).alias("size"), "mtime")
    return files.stale_sources(recorded, now.where("source <> 'region'"))


def profile_of_files(spark, sf_dir):
    """A profile taken file by file: the later files are read when they come, the earlier are not read again."""
    orders = read(spark, sf_dir, "orders")
    data, store = _scratch(spark, "orders"), _scratch(spark, "profile")
    orders.where("o_orderkey % 4 > 0").repartition(3, "o_orderkey").write.parquet(data)
    kept = FileProfiles(spark, data, store)
    first = kept.refresh()
    orders.where("o_orderkey % 4 = 0").coalesce(1).write.mode("append").parquet(data)
    second = kept.refresh()
    again = len(set(first.read) & set(second.read))
    return kept.profile().select("name", "n_rows", "n_null", "n_distinct", rounded("mean", 4), rounded("std", 4), rounded("median", 4),
                                 "top_freq", commas("flags").alias("flags"), F.lit(again).alias("read_again"), F.lit(len(second.read)).alias("read_last"))


QUERIES = {
    "files_found": files_found,
    "files_stale": files_stale,
    "table_measures": table_measures,
    "table_preview": table_preview,
    "profile_of_files": profile_of_files,
    "csv_typed": csv_typed,
    "parquet_sink": parquet_sink,
    "csv_profile": csv_profile,
}

def _profile_sql() -> str:
    kinds = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "s"}
    number = lambda c, k, f: f"round({f}({c}), 4)" if k == "n" else "NULL::DOUBLE"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
        f"{number(c, k, 'avg')} AS mean, {number(c, k, 'stddev_samp')} AS std, {number(c, k, 'median')} AS median, "
        + (f"(SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {c}))" if k != "n" else "NULL::BIGINT") + " AS top_freq, "
        f"concat_ws(',', CASE WHEN count(DISTINCT {c}) = 1 THEN 'constant' END, CASE WHEN count(DISTINCT {c}) = count(*) THEN 'possible_key' END) AS flags, "
        "0 AS read_again, 1 AS read_last FROM orders" for c, k in kinds.items())


ORACLES = {
    "files_found": f"""SELECT table_name AS name, ordinal_position AS position, column_name AS "column" FROM information_schema.columns
        WHERE table_name IN {_TABLES}""",
    "files_stale": f"""SELECT DISTINCT table_name AS source, CASE table_name WHEN 'orders' THEN true WHEN 'region' THEN true ELSE false END AS stale
        FROM information_schema.columns WHERE table_name IN {_TABLES}""",
    "table_measures": """SELECT count(*) AS n, min(l_quantity) AS least, count(DISTINCT l_returnflag) AS flags, max(l_shipdate) AS latest,
        round(max(l_extendedprice * (1 - l_discount)), 4) AS most_paid, 0 AS nothing FROM lineitem""",
    "table_preview": """SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::INT AS place, o_orderkey, o_custkey,
        (SELECT count(*) FROM orders) AS n_rows, 3 AS n_cols FROM orders QUALIFY place < 7""",
    "profile_of_files": _profile_sql(),
    "csv_typed": """SELECT event_id, ts, event_type, CASE WHEN user_id % 5 > 0 THEN user_id END AS user_id,
        CASE WHEN user_id % 7 > 0 THEN value END AS value, CAST(ts AS DATE) AS day, value > 10 AS large, props
        FROM events""",
    "parquet_sink": "SELECT * FROM part",
    "csv_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"count(DISTINCT {c}) AS n_distinct FROM customer"
        for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "bigint"),
                     ("c_acctbal", "double"), ("c_mktsegment", "string"))),
}
