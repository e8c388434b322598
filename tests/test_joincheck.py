import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.operators.joincheck import HOWS, JoinCheck
from tallyframe.operators.joining import PROVENANCE_KEYS, apply_join
from tallyframe.operators.keys import resolve_keys


def test_known_report(orders, customers):
    report = JoinCheck(orders, customers, "customer_id").report_dict()
    assert report["relationship"] == "many:many"
    assert {h: j["result_rows"] for h, j in report["joins"].items()} == {
        "inner": 8, "left": 10, "right": 9, "outer": 11}
    assert report["joins"]["inner"]["left_dropped"] == 2
    assert report["joins"]["inner"]["right_dropped"] == 1
    assert report["overlap"]["n_shared_keys"] == 4
    assert (report["overlap"]["left_coverage"], report["overlap"]["right_coverage"]) == (0.75, 0.8333)
    assert report["overlap"]["sample_left_only"] == [7777.0]
    assert report["overlap"]["sample_right_only"] == [1004]
    assert report["fan_out"] == {
        "max_left_to_right": 2, "max_right_to_left": 2, "result_per_matched_left": 1.3333}
    assert report["flags"] == [
        "many_to_many", "left_rows_dropped", "fan_out", "null_keys", "right_rows_dropped"]
    assert report["left"] == {"n_rows": 8, "n_null_keys": 1, "n_distinct_keys": 5,
                              "n_duplicated_keys": 2, "max_key_multiplicity": 2, "unique_keys": False}


def test_findings_show_the_rows_behind_the_numbers(orders, customers):
    evidence = JoinCheck(orders, customers, "customer_id").findings()["evidence"]
    assert [r["order_id"] for r in evidence["unmatched_left_rows"]] == [9005]
    assert [r["name"] for r in evidence["unmatched_right_rows"]] == ["Echo"]
    assert [r["order_id"] for r in evidence["null_key_left_rows"]] == [9006]
    assert evidence["null_key_right_rows"] == []
    assert evidence["fan_out_examples"] == [
        {"key": 1001.0, "n_left": 2, "n_right": 2}, {"key": 1002.0, "n_left": 2, "n_right": 1}]


def test_a_large_fan_out_is_counted_not_built(spark):
    side = spark.range(200_000).select((F.col("id") % 1000).alias("k"))
    report = JoinCheck(side, side, "k").report_of_measured()
    assert report["joins"]["inner"]["result_rows"] == 40_000_000
    assert report["fan_out"]["max_left_to_right"] == 200


def test_products_past_64_bits_are_counted(spark):
    """Multiplicities as a huge table would give them: the product is taken wide."""
    from tallyframe.operators import joincheck

    aligned = spark.createDataFrame([(1, 4_000_000_000_000, 1, 4_000_000_000_000)],
                                    "lk0 bigint, ln bigint, rk0 bigint, rn bigint")
    row = aligned.agg(*map(F.expr, joincheck._overlap_counts(1))).first()
    assert int(row["inner_rows"]) == 16 * 10**24


def test_composite_keys_come_back_as_lists(bookings, city_events, hotels):
    placed = apply_join(bookings, hotels, how="left", on="hotel_id").df
    report = JoinCheck(placed, city_events, left_on=["city", "stay_date"],
                       right_on=["city_name", "event_date"]).report_dict()
    assert report["overlap"]["sample_right_only"] == [[" paris", "2026-06-12"], ["Lyon", "2026-06-12"]]
    assert report["left"]["n_null_keys"] == 1


def test_mismatched_kinds_are_compared_as_text_and_reported(spark):
    numbers = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    texts = spark.createDataFrame([("2",), ("x",)], "k string")
    report = JoinCheck(numbers, texts, "k").report_dict()
    assert report["key_dtype_match"] is False
    assert report["key_dtypes"] == {"left": ["numeric"], "right": ["string"]}
    assert report["flags"][0] == "key_dtype_mismatch"
    assert report["joins"]["inner"]["result_rows"] == 1
    assert report["overlap"]["sample_left_only"] == [1, 3]
    assert apply_join(numbers, texts, how="inner", on="k").df.count() == 1


def test_wide_integers_against_doubles_keep_their_own_distinct_counts(spark):
    near = spark.createDataFrame([(2**53,), (2**53 + 1,)], "k bigint")
    floats = spark.createDataFrame([(float(2**53),)], "k double")
    check = JoinCheck(near, floats, "k")
    report = check.report_of_measured()
    assert report["left"]["n_distinct_keys"] == 2
    assert report["joins"]["inner"]["result_rows"] == apply_join(near, floats, on="k").df.count()


@pytest.mark.parametrize("key_type", ["int", "decimal(10,2)", "float"])
def test_numbers_of_any_type_match(spark, key_type):
    left = spark.createDataFrame([(1,), (2,)], "k bigint")
    right = left.select(F.col("k").cast(key_type).alias("k"))
    assert JoinCheck(left, right, "k").report_of_measured()["joins"]["inner"]["result_rows"] == 2


def test_no_matches_and_empty_sides(spark, customers):
    none = customers.limit(0)
    report = JoinCheck(customers, none, "customer_id").report_dict()
    assert report["flags"] == ["no_matches", "left_rows_dropped", "low_overlap"]
    assert report["overlap"]["right_coverage"] == 0.0
    both = JoinCheck(none, none, "customer_id").report_of_measured()
    assert both["joins"]["outer"]["result_rows"] == 0


def test_key_arguments():
    assert resolve_keys("a").shared and resolve_keys(["a", "b"]).left == ("a", "b")
    assert not resolve_keys(left_on="a", right_on="b").shared
    with pytest.raises(ValueError, match="differ in length"):
        resolve_keys(left_on=["a"], right_on=["b", "c"])
    with pytest.raises(ValueError, match="give `on`"):
        resolve_keys()


def test_missing_columns_name_their_side(orders, customers):
    with pytest.raises(ValueError, match="right table lacks"):
        JoinCheck(orders, customers, left_on="customer_id", right_on="nope")


def test_names_with_dots_and_quotes(spark):
    odd = spark.createDataFrame([(1, 2)], "`a.b` bigint, `c``d` bigint")
    assert JoinCheck(odd, odd, ["a.b", "c`d"]).report_of_measured()["joins"]["inner"]["result_rows"] == 1
    assert apply_join(odd, odd, on="a.b").df.columns == ["a.b", "c`d_x", "c`d_y"]


def test_unmatched_rows_are_the_same_by_broadcast_and_by_shuffle(orders, customers):
    lazy, measured = (JoinCheck(orders, customers, "customer_id") for _ in range(2))
    measured.measured()
    for side in ("left", "right"):
        assert rows_of(lazy.unmatched_rows_all(side)) == rows_of(measured.unmatched_rows_all(side))


keys = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=keys, right=keys)
def test_prediction_equals_reality_for_every_join_type(spark, left, right):
    """And the split plan gives the very rows of the plain one."""
    a = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "k bigint, a bigint")
    b = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k bigint, b bigint")
    predicted = JoinCheck(a, b, "k").report_of_measured()["joins"]
    for how in HOWS:
        plain = apply_join(a, b, how=how, on="k", diagnose=False).df.collect()
        split = apply_join(a, b, how=how, on="k", hot_key_rows=2).df.collect()
        assert len(plain) == predicted[how]["result_rows"]
        assert sorted(map(str, plain)) == sorted(map(str, split))


def test_hot_copies_are_spread_over_cells(spark):
    """A key held by identical rows is still cut into several cells."""
    left = spark.range(0, 4000, 1, 8).select(F.lit(7).alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(7, "r"), (8, "s")], "k int, w string")
    joined = apply_join(left, right, how="outer", on="k", hot_key_rows=500)
    assert joined.df.count() == 4001
    assert "l_sl" in joined.df._jdf.queryExecution().optimizedPlan().toString()


def test_provenance_fields_match_their_declaration(orders, customers):
    done = apply_join(orders, customers, how="left", on="customer_id").provenance()
    assert set(done) == PROVENANCE_KEYS
    assert done["matches_prediction"] and done["result_rows"] == 10


def test_naming(spark, orders, customers):
    shared = apply_join(orders, customers, how="outer", on="customer_id").df
    assert shared.columns == ["order_id", "customer_id", "amount", "name"]
    assert shared.where("customer_id = 1004").count() == 1
    other = customers.withColumnRenamed("customer_id", "id").withColumn("amount", F.lit(1))
    two = apply_join(orders, other, left_on="customer_id", right_on="id").df
    assert two.columns == ["order_id", "customer_id", "amount_x", "id", "name", "amount_y"]
    clash = spark.createDataFrame([(1, 2, 3)], "k int, a int, a_x int")
    with pytest.raises(ValueError, match="repeat column name"):
        apply_join(clash, clash.select("k", "a"), on="k")
    with pytest.raises(ValueError, match="how must be"):
        apply_join(orders, customers, how="cross", on="customer_id")


def test_a_self_join_keeps_both_sides(customers):
    assert apply_join(customers, customers, on="customer_id").df.columns == [
        "customer_id", "name_x", "name_y"]
