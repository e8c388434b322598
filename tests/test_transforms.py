import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import normalize as N
from tallyframe.operators.normalize import apply_normalize
from tallyframe.operators.sqlstep import PROVENANCE_KEYS, SqlRefused, apply_sql


def t(column, op, **more):
    return {"column": column, "op": op, **more}


@pytest.fixture(scope="module")
def amounts(spark):
    return spark.createDataFrame([(" 1.5 ", 1), ("2", 2), ("pending", 3), (None, 4), ("12D", 5)],
                                 "amount string, id bigint")


def test_failures_are_counted_and_shown(amounts):
    done = apply_normalize(amounts, [t("amount", "strip"), t("amount", "to_numeric")])
    p = done.provenance()
    assert p == {
        "op": "normalize", "input_rows": 5, "flags": ["coercion_failures"],
        "transforms": [
            {"column": "amount", "op": "strip", "n_changed": 1},
            {"column": "amount", "op": "to_numeric", "n_converted": 2, "n_failed": 2,
             "sample_failed": ["12D", "pending"]}]}
    assert set(p) == N.PROVENANCE_KEYS
    assert [r["amount"] for r in done.df.orderBy("id").collect()] == [1.5, 2.0, None, None, None]


def test_fill_replaces_failures_and_nulls_but_counts_them(amounts):
    done = apply_normalize(amounts, [t("amount", "to_numeric", fill=0)])
    assert [r["amount"] for r in done.df.orderBy("id").collect()] == [1.5, 2.0, 0.0, 0.0, 0.0]
    assert done.provenance()["transforms"][0]["n_failed"] == 2


def test_lower_and_to_string(spark):
    df = spark.createDataFrame([("Paris", 1.5), ("lyon", None)], "city string, v double")
    done = apply_normalize(df, [t("city", "lower"), t("v", "to_string")])
    assert [x["n_changed"] for x in done.provenance()["transforms"]] == [1, 1]
    assert done.df.schema["v"].dataType.simpleString() == "string"
    assert done.df.columns == df.columns


def test_dates_do_not_become_numbers(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), True)], "d date, b boolean")
    done = apply_normalize(df, [t("d", "to_numeric"), t("b", "to_numeric")])
    assert tuple(done.df.first()) == (None, 1.0)


def test_no_transforms_pass_through(amounts):
    done = apply_normalize(amounts, [])
    assert done.df.count() == 5 and done.provenance()["transforms"] == []


def test_unknown_columns_and_ops_are_refused(amounts):
    with pytest.raises(ValueError, match="no column"):
        apply_normalize(amounts, [t("nope", "strip")])
    with pytest.raises(ValueError, match="is not one of"):
        apply_normalize(amounts, [t("amount", "upper")])


def test_all_counts_come_from_one_job(spark, amounts):
    done = apply_normalize(amounts, [t("amount", "strip"), t("amount", "lower"), t("id", "to_string")])
    plan = done.counts()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


ALLOWED = (
    "SELECT * FROM a",
    "with q as (select x from a) select * from q join b on x = y",
    "SELECT * FROM a WHERE x IN (SELECT y FROM b)",
    "SELECT (SELECT max(y) FROM b) AS m, x FROM a",
    "WITH b2 AS (SELECT * FROM b) SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b2 WHERE y = x)",
    "WITH a AS (SELECT y AS x FROM b) SELECT * FROM a",
    "SELECT x FROM a UNION ALL SELECT y FROM b;",
    "SELECT x, sum(x) OVER (ORDER BY x) AS s FROM a -- copy nothing",
    "SELECT x % 2 AS g, count(*) AS n FROM a GROUP BY ROLLUP (x % 2)",
)
REFUSED = (
    "", "  -- only a comment", "DROP TABLE a", "SELECT 1; SELECT 2", "SELECT * FROM secret",
    "WITH q AS (SELECT * FROM secret) SELECT * FROM q", "SELECT * FROM a WHERE x IN (SELECT id FROM secret)",
    "INSERT INTO a SELECT * FROM b", "CREATE TABLE z AS SELECT * FROM a", "SET x = 1",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM a",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM a",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM default.secret",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT * FROM a JOIN LATERAL (SELECT * FROM secret) ON true",
    "SELECT TRANSFORM(x) USING 'cat' FROM a", "SELECT * FROM read_files('/tmp')",
    "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "WITH q AS (SELECT * FROM IDENTIFIER('secret')) SELECT * FROM q",
    "SELECT (SELECT max(id) FROM IDENTIFIER('secret')) AS m FROM a", "TABLE secret",
    "COPY a TO 'x'", "EXPORT DATABASE 'x'", "ATTACH 'x'", "INSTALL httpfs", "LOAD x",
)


@pytest.fixture
def inputs(spark):
    spark.range(3).createOrReplaceTempView("secret")
    yield {"a": spark.range(5).toDF("x"), "b": spark.range(3).toDF("y")}
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("sql", ALLOWED)
def test_reads_are_allowed(inputs, sql):
    assert apply_sql(inputs, sql).df.count() > 0


@pytest.mark.parametrize("sql", REFUSED)
def test_everything_else_is_refused(inputs, sql):
    with pytest.raises(Exception) as refused:
        apply_sql(inputs, sql)
    assert isinstance(refused.value, SqlRefused) or "PARSE_SYNTAX_ERROR" in str(refused.value)


@pytest.mark.parametrize("sql", ("SELECT 'load' AS w FROM a", "SELECT 'a;b' AS w FROM a", "SELECT 1 AS force, 2 AS copy FROM a"))
def test_words_in_literals_and_names_are_allowed(inputs, sql):
    assert apply_sql(inputs, sql).df.count() == inputs["a"].count()


def test_views_of_the_caller_come_back(spark, inputs):
    spark.range(9).createOrReplaceTempView("a")
    apply_sql(inputs, "SELECT * FROM a")
    assert spark.table("a").count() == 9
    spark.catalog.dropTempView("a")
    assert not spark.catalog.tableExists("b")


def test_types_and_provenance(spark, bookings):
    done = apply_sql({"otb": bookings}, "SELECT stay_date, sum(revenue) AS r FROM otb GROUP BY stay_date")
    assert done.df.schema["stay_date"].dataType.simpleString() == "date"
    p = done.provenance()
    assert set(p) == PROVENANCE_KEYS
    assert (p["input_rows"], p["result_rows"], p["columns"]) == ({"otb": 14}, 7, ["stay_date", "r"])
