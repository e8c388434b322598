import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import catalog as C
from tallyframe.operators.profile import candidate_keys, null_rates, profile, profile_dict
from tallyframe.operators.quartiles import distributed_quartiles


def column(df, name, **options):
    return next(c for c in profile_dict(df, **options)["columns"] if c["name"] == name)


@pytest.fixture(scope="module")
def messy(spark):
    base = spark.range(40).select(F.col("id").cast("int").alias("i"))
    return base.selectExpr(
        "i + 1000 AS id",
        "CASE WHEN i % 5 = 0 THEN concat(' ', i, ' ') WHEN i = 7 THEN 'pending' WHEN i = 11 THEN NULL ELSE cast(i AS string) END AS amount",
        "CASE WHEN i % 3 = 0 THEN concat('note ', i) END AS note",
        "'v2' AS source", "CAST(NULL AS STRING) AS legacy",
        "CASE WHEN i % 2 = 0 THEN cast(i AS string) ELSE concat('ref-', i) END AS ref",
        "element_at(array('DE', 'FR', 'US', 'US'), i % 4 + 1) AS country",
        "i % 2 = 0 AS even")


def test_flags(messy):
    flags = {c["name"]: c["flags"] for c in profile_dict(messy)["columns"]}
    assert flags == {
        "id": ["possible_key"],
        "amount": ["mixed_types", "leading_trailing_whitespace", "numeric_stored_as_text", "high_cardinality"],
        "note": ["high_null", "high_cardinality"],
        "source": ["constant"],
        "legacy": ["all_null"],
        "ref": ["possible_key", "mixed_types", "high_cardinality"],
        "country": [],
        "even": [],
    }


def test_labels_and_modal_values(messy):
    found = profile_dict(messy)
    assert {c["name"]: c["inferred"] for c in found["columns"]} == {
        "id": "integer", "amount": "text", "note": "text", "source": "categorical", "legacy": "empty",
        "ref": "text", "country": "categorical", "even": "boolean"}
    assert found["candidate_keys"] == ["id", "ref"]
    assert (column(messy, "country")["top"], column(messy, "country")["top_freq"]) == ("US", 20)
    assert "top" not in column(messy, "even") and "q25" not in column(messy, "even")
    assert "top" not in column(messy, "id")


def test_modal_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert (column(df, "v")["top"], column(df, "v")["top_freq"]) == ("a", 2)
    days = spark.createDataFrame([(dt.date(2026, 1, 2),), (dt.date(2026, 1, 1),)], "v date")
    assert column(days, "v")["top"] == "2026-01-01"


def test_numeric_facts(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "v bigint")
    c = column(df, "v")
    assert (c["q25"], c["median"], c["q75"], c["mean"]) == (1.75, 3.0, 5.25, 4.0)
    assert c["std"] == 3.5590 and (c["min"], c["max"]) == ("1", "9")
    assert column(df.limit(1), "v")["std"] is None


def test_integers_past_double_precision_stay_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v bigint")
    c = column(df, "v")
    assert c["n_distinct"] == 2 and c["samples"] == [str(2**53), str(2**53 + 1)]


def test_signed_zeros_and_nan_are_single_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "v double")
    assert column(df, "v")["n_distinct"] == 2


def test_decimals_are_numbers(spark):
    df = spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.50"),)], "v decimal(10,2)")
    c = column(df, "v")
    assert (c["inferred"], c["median"], c["n_distinct"]) == ("float", 2.0, 2)


def test_nested_values_are_counted(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([3],)], "v array<int>")
    c = column(df, "v")
    assert (c["n_distinct"], c["top"], c["top_freq"], c["inferred"]) == (2, "[1,2]", 2, "categorical")


def test_empty_tables_and_columns(spark):
    found = profile_dict(spark.createDataFrame([], "a bigint, b string"))
    assert found["n_rows"] == 0
    assert [c["flags"] for c in found["columns"]] == [["all_null"], ["all_null"]]
    assert [c["null_rate"] for c in found["columns"]] == [0.0, 0.0]


def test_long_text_gives_the_same_answers_as_short(spark):
    """Digests change what is shuffled, not what is found."""
    prefix = "p" * 30
    rows = [(prefix + t,) for t in ("bb", "aa", "aa", "bb", "c", " ", "12")] + [("z",), ("  9",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    whole = profile(df, long_text=10_000).collect()
    for limit in (1, 5, 30, 31):
        assert profile(df, long_text=limit).collect() == whole
    assert whole[0]["top"] == prefix + "aa" and whole[0]["n_distinct"] == 7


def test_all_long_and_all_distinct(spark):
    df = spark.range(50).select(F.concat(F.lit("x" * 100), F.format_string("%03d", "id")).alias("v"))
    c = column(df, "v", long_text=64)
    assert c["samples"] == ["x" * 100 + n for n in ("000", "001", "002")]
    assert c["top"] == "x" * 100 + "000" and c["top_freq"] == 1


@pytest.mark.parametrize("expression", [
    "id", "id % 3", "CAST(7 AS BIGINT)", "CASE WHEN id < 700 THEN 5 ELSE id END",
    "pow(10, id % 40) * (CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END)", "nullif(id % 50, 3)"])
def test_distributed_quartiles_are_exact(spark, expression):
    table = spark.range(1001).selectExpr(f"{expression} AS c0")
    exact = table.selectExpr("percentile(c0, array(0.25, 0.5, 0.75))").first()[0]
    n = table.where("c0 IS NOT NULL").count()
    for limit in (1, 20, 400):
        assert distributed_quartiles(table, {0: n}, limit=limit)[0] == pytest.approx(list(exact))


def test_a_poor_sketch_costs_passes_not_correctness(spark, monkeypatch):
    import tallyframe.operators.quartiles as Q

    monkeypatch.setattr(Q, "SKETCH", 3)
    monkeypatch.setattr(Q, "PROPOSING_ROWS", 4)
    table = spark.range(500).selectExpr("pow(id, 3) AS c0")
    exact = table.selectExpr("percentile(c0, array(0.25, 0.5, 0.75))").first()[0]
    assert distributed_quartiles(table, {0: 500}, limit=5)[0] == pytest.approx(list(exact))


def test_held_input_gives_the_same_profile(messy):
    assert profile_dict(messy, columnar=False) == profile_dict(messy)
    assert profile_dict(messy, columns_per_job=3) == profile_dict(messy)


def test_tall_and_short_tables_are_counted_alike(messy):
    """Each column on its own, and columns of a type together, give one answer."""
    assert profile_dict(messy, quartile_rows=10) == profile_dict(messy)
    assert profile_dict(messy, quartile_rows=39, long_text=2) == profile_dict(messy)


def test_null_rates(messy, spark):
    rates = {r["name"]: round(r["null_rate"], 4) for r in null_rates(messy).collect()}
    assert rates["note"] == 0.65 and rates["legacy"] == 1.0 and rates["id"] == 0.0
    assert [r["null_rate"] for r in null_rates(spark.createDataFrame([], "a int")).collect()] == [0.0]


def test_column_names_need_no_care(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`a.b` int, `n_rows` string, `A.b` int")
    assert [c["name"] for c in profile_dict(df)["columns"]] == ["a.b", "n_rows", "A.b"]


def test_numbers_in_text(spark):
    texts = [" 12 ", "1e5", ".5", "+5", "-inf", "NaN", "12D", "1f", "0x1p3", "1_000", "", "abc", "1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert profile(df).first()["n_numeric"] == 6


def test_spaces_are_space_separators(spark):
    df = spark.createDataFrame([(" a",), ("a　",), ("\ta",), ("a\n",), ("a",)], "v string")
    assert profile(df).first()["n_whitespace"] == 2


def test_catalog_keeps_judgments_and_refreshes_facts(messy, spark):
    facts = C.column_facts(profile(messy), "messy")
    recorded = spark.createDataFrame([("messy", "id", "key"), ("messy", "gone", "old")],
                                     "source string, name string, role string")
    fresh = {r["name"]: r["role"] for r in C.refresh(facts, recorded).collect()}
    assert fresh["id"] == "key" and fresh["note"] is None and "gone" not in fresh
    summary = C.source_summary(profile(messy), "messy").first()
    assert summary["candidate_keys"] == ["id", "ref"]
    assert "legacy (empty)" in summary["watch_outs"] and "note (mostly null)" in summary["watch_outs"]
    written = spark.createDataFrame([("messy", "A read.", False)], "source string, summary string, drafted boolean")
    kept = C.refresh_sources(C.source_summary(profile(messy), "messy"), written).first()
    assert kept["summary"] == "A read." and not kept["drafted"]


def test_candidate_keys(messy):
    assert [r["name"] for r in candidate_keys(profile(messy)).orderBy("position").collect()] == ["id", "ref"]
