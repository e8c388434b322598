"""Plan shapes that must hold, and every registered query against its oracle."""

import ast
import datetime as dt
import math
import os
import re
from pathlib import Path

import pytest

import registry
from registry.joins import PAIRS
from tallyframe.operators.joincheck import JoinCheck
from tallyframe.operators.joining import apply_join

ROOT = Path(__file__).resolve().parent.parent
# the training-data operators have rules and tests of their own
SOURCES = [p for p in [*ROOT.glob("tallyframe/**/*.py"), *ROOT.glob("registry/*.py")] if p.parent.name != "llm"]
DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@needs_data
def test_a_join_report_reads_keys_only_and_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(JoinCheck(read(spark, "lineitem"), read(spark, "orders"),
                              left_on="l_orderkey", right_on="o_orderkey").report())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 2
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == ["l_orderkey:bigint", "o_orderkey:bigint"]


@needs_data
def test_examples_never_sort_a_whole_table(spark):
    check = JoinCheck(read(spark, "events"), read(spark, "customer"), left_on="user_id", right_on="c_custkey")
    for frame in (check.unmatched_keys("right"), check.unmatched_rows("right"), check.fan_out_examples(),
                  check.null_key_rows("left")):
        assert "TakeOrderedAndProject" in plan(frame)


@needs_data
def test_joins_without_hot_keys_are_left_to_spark(spark):
    text = plan(apply_join(read(spark, "orders"), read(spark, "customer"), how="left",
                           left_on="o_custkey", right_on="c_custkey").df)
    assert "Union" not in text and "xxhash64" not in text


def test_no_plan_uses_a_cross_join_or_a_machine_local_cut():
    for path in SOURCES:
        source = path.read_text(encoding="utf-8")
        for banned in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "toLocalIterator", "@udf", "pandas_udf"):
            assert banned not in source, f"{banned} in {path}"


def test_rows_reach_the_driver_in_few_known_places():
    """Every collect is of columns, steps, files, tree nodes, bounded keys or capped examples."""
    allowed = {"profile.py", "quartiles.py", "joincheck.py", "normalize.py", "outcome.py", "table.py", "readers.py",
               "interval.py", "dedupe.py", "drift.py", "fileprofile.py", "graphstore.py"}
    for path in SOURCES:
        calls = [n for n in ast.walk(ast.parse(path.read_text(encoding="utf-8")))
                 if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "collect"]
        assert not calls or path.name in allowed, path


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracles())
    assert len(PAIRS) == 8


def norm(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else round(value, 6) + 0.0)
    if isinstance(value, dt.datetime):
        return ("time", value.isoformat())
    return (type(value).__name__, str(value))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str([norm(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.oracles():
        assert rows
        return
    result = duck.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(str([norm(r[i]) for i in order]) for r in result.fetchall())
