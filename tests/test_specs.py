import pytest
import yaml
from conftest import rows_of

from tallyframe.plans import ctas
from tallyframe.plans.metrics import append_metrics, drift_frame, run_metrics
from tallyframe.plans.models import build_models, build_order, load_models
from tallyframe.plans.spec import WriteRefused, load_spec, run_spec, table_at, write_gated
from tallyframe.sources import readers, writers

SOURCES = {"otb": "otb", "hotels": "hotels", "city_events": "city_events"}
CLEAN = [
    {"id": "events_clean", "op": "normalize", "input": "city_events",
     "transforms": [{"column": "city_name", "op": "strip"}, {"column": "city_name", "op": "lower"}]},
    {"id": "hotels_clean", "op": "normalize", "input": "hotels", "transforms": [{"column": "city", "op": "lower"}]},
    {"id": "otb_hotels", "op": "join", "left": "otb", "right": "hotels_clean", "keys": ["hotel_id"], "how": "left"},
]
FAN_OUT = {"id": "with_events", "op": "join", "left": "otb_hotels", "right": "events_clean",
           "left_on": ["city", "stay_date"], "right_on": ["city_name", "event_date"], "how": "left",
           "grain": ["booking_id"]}
ONE_PER_DAY = {"id": "per_day", "op": "sql", "inputs": ["events_clean"],
               "sql": "SELECT city_name, event_date, sum(expected_attendance) AS attendance "
                      "FROM events_clean GROUP BY city_name, event_date"}
SAFE = {**FAN_OUT, "right": "per_day"}


@pytest.fixture(scope="module")
def tables(bookings, hotels, city_events):
    return {"otb": bookings, "hotels": hotels, "city_events": city_events}


def run(spark, tables, steps, **options):
    return run_spec(spark, {"sources": SOURCES, "steps": steps}, tables=tables, **options)


def test_a_fan_out_is_caught_by_its_grain(spark, tables):
    last = run(spark, tables, [*CLEAN, FAN_OUT])[-1]
    assert last.provenance["result_rows"] == 18 and last.provenance["matches_prediction"]
    assert last.outcome["flags"] == ["grain_not_unique"] == last.blocking
    assert last.df.groupBy().sum("revenue").first()[0] > 136240


def test_aggregating_first_keeps_the_truth(spark, tables):
    last = run(spark, tables, [*CLEAN, ONE_PER_DAY, SAFE])[-1]
    assert last.blocking == [] and last.df.count() == 14
    assert tuple(last.df.groupBy().sum("revenue", "rooms_sold").first()) == (136240.0, 147)


def test_acknowledged_flags_stay_visible_but_do_not_block(spark, tables):
    last = run(spark, tables, [*CLEAN, {**FAN_OUT, "acknowledge": ["grain_not_unique"]}])[-1]
    assert last.outcome["flags"] == ["grain_not_unique"] and last.blocking == []


@pytest.mark.parametrize("pin", [False, True])
def test_normalize_counts_in_one_pass_agree_with_counting_apart(spark, tables, pin):
    first = run(spark, tables, [*CLEAN], pin_steps=pin)
    assert [t["n_changed"] for t in first[0].provenance["transforms"]] == [1, 6]
    assert first[0].outcome["n_rows"] == 7 and first[0].outcome["n_cols"] == 4
    assert first[2].outcome["null_rates"] == {
        "hotel_name": 0.0714, "city": 0.0714, "country": 0.0714, "rooms": 0.0714}


def test_drift_and_expectations(spark, tables):
    steps = [*CLEAN[:2], {**CLEAN[2], "expect": {"result_rows": 10.0, "left_dropped": 0}}]
    last = run(spark, tables, steps)[-1]
    assert last.drift == {"result_rows": {"expected": 10.0, "actual": 14}}
    with pytest.raises(ValueError, match="never measures"):
        run(spark, tables, [*CLEAN[:2], {**CLEAN[2], "expect": {"rows": 1}}])
    with pytest.raises(ValueError, match="expects what it cannot report"):
        run(spark, tables, [*CLEAN[:2], {**CLEAN[2], "expect": {"flags": 1}}])


def test_compiled_sql_equals_the_frames(spark, tables):
    steps = [*CLEAN, ONE_PER_DAY, SAFE,
             {"id": "num", "op": "normalize", "input": "per_day",
              "transforms": [{"column": "attendance", "op": "to_string"},
                             {"column": "attendance", "op": "to_numeric", "fill": 1},
                             {"column": "city_name", "op": "to_numeric"}]},
             {"id": "outer", "op": "join", "left": "per_day", "right": "events_clean",
              "keys": ["city_name", "event_date"], "how": "outer"}]
    for upto in ("with_events", "num", "outer"):
        results = run(spark, tables, steps, upto=upto, measure=False)
        assert rows_of(ctas.compiled_frame(spark, results)) == rows_of(results[-1].df)
    text = ctas.create_sql("m", results)
    assert text.startswith("CREATE TABLE `m` USING parquet AS\nWITH `events_clean` AS (")


def test_a_compiled_model_creates_its_table(spark, tables, tmp_path):
    results = run(spark, tables, CLEAN, measure=False)
    names = ctas.register_inputs(spark, results)
    spark.sql(ctas.create_sql("built_model", results, location=f"{tmp_path}/built_model"))
    assert rows_of(spark.table("built_model")) == rows_of(results[-1].df)
    spark.sql("DROP TABLE built_model")
    for name in names:
        spark.catalog.dropTempView(name)


def test_earlier_steps_can_be_read(spark, tables):
    spec = {"sources": SOURCES, "steps": CLEAN}
    assert table_at(spark, spec, "hotels_clean", tables=tables).where("city = 'paris'").count() == 2
    with pytest.raises(ValueError, match="no step"):
        table_at(spark, spec, "nope", tables=tables)


MODELS = {
    "stg": {"sources": SOURCES, "steps": CLEAN, "layer": "staging"},
    "mart": {"layer": "mart", "steps": [
        {"id": "s", "op": "sql", "inputs": ["stg"], "sql": "SELECT city, sum(revenue) AS r FROM stg GROUP BY city"}]},
    "twice": {"steps": [{"id": "j", "op": "join", "left": "stg", "right": "mart", "keys": ["city"]}]},
}


def test_models_build_inputs_first_and_once(spark, tables, tmp_path):
    assert build_order(MODELS) == ["stg", "mart", "twice"]
    assert build_order(MODELS, "mart") == ["stg", "mart"]
    built = build_models(spark, MODELS, tables=tables, out_dir=str(tmp_path))
    assert [m.path for m in built] == [f"{tmp_path}/staging/stg", f"{tmp_path}/mart/mart", f"{tmp_path}/twice"]
    assert spark.read.parquet(built[1].path).count() == 4
    plain = build_models(spark, MODELS, tables=tables)
    assert rows_of(plain[-1].df) == rows_of(built[-1].df)


def test_cycles_and_unknown_names_are_refused(spark, tables):
    loop = {"a": {"steps": [{"id": "x", "op": "sql", "inputs": ["b"], "sql": "select 1"}]},
            "b": {"steps": [{"id": "y", "op": "sql", "inputs": ["a"], "sql": "select 1"}]}}
    with pytest.raises(ValueError, match="cycle"):
        build_order(loop)
    with pytest.raises(ValueError, match="cycle"):
        run_spec(spark, loop["a"], models=loop)
    with pytest.raises(ValueError, match="no source, earlier step or model"):
        run(spark, tables, [{"id": "x", "op": "normalize", "input": "nope", "transforms": []}])
    with pytest.raises(ValueError, match="unknown op"):
        run(spark, tables, [{"id": "x", "op": "pivot", "input": "otb"}])
    with pytest.raises(ValueError, match="layer"):
        build_models(spark, {"a": {**MODELS["stg"], "layer": "gold"}}, tables=tables)


def test_the_gate_refuses_and_lets_through(spark, tables, tmp_path):
    models = {"bad": {"sources": SOURCES, "steps": [*CLEAN, FAN_OUT]},
              "good": {"sources": SOURCES, "steps": [*CLEAN, ONE_PER_DAY, SAFE]}}
    built = {m.name: m for m in build_models(spark, models, tables=tables, out_dir=str(tmp_path), gate=True)}
    assert built["bad"].path is None and built["bad"].refused == ["grain_not_unique"]
    assert not (tmp_path / "bad").exists() and (tmp_path / "good").exists()
    with pytest.raises(WriteRefused):
        build_models(spark, models, tables=tables, out_dir=str(tmp_path), gate=True, only="bad")
    with pytest.raises(WriteRefused):
        write_gated(built["bad"].results[-1], writers.write_parquet, str(tmp_path / "x"))


def test_a_self_join_tells_its_sides_apart(spark, tables):
    step = {"id": "s", "op": "join", "left": "hotels", "right": "hotels", "keys": ["hotel_id"]}
    outcome = run(spark, tables, [step])[-1].outcome
    assert set(outcome["contribution"]) == {"hotels:left", "hotels:right"}
    assert outcome["contribution"]["hotels:right"]["columns_in_output"] == [
        "city_y", "country_y", "hotel_name_y", "rooms_y"]


def test_metrics_append_and_drift(spark, tables, tmp_path):
    results = run(spark, tables, [*CLEAN, FAN_OUT])
    metrics = run_metrics(spark, "r1", "m", results)
    found = {(r["step"], r["field"]): r["value"] for r in metrics.collect()}
    assert found["with_events", "result_rows"] == "18"
    assert found["with_events", "grain.n_duplicated_keys"] == "4"
    assert found["with_events", "grain_not_unique"] == "true"
    for run_id in ("r1", "r2"):
        append_metrics(run_metrics(spark, run_id, "m", results), str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).select("run").distinct().count() == 2
    expected = spark.createDataFrame([("with_events", "result_rows", "14"), ("with_events", "how", "left")],
                                     "step string, field string, value string")
    drift = drift_frame(expected, metrics.where("part = 'provenance'").select("step", "field", "value"))
    assert [tuple(r) for r in drift.collect()] == [("with_events", "result_rows", "14", "18")]


def test_a_yaml_project_from_files(spark, tables, tmp_path):
    for name, df in tables.items():
        (writers.write_csv if name == "otb" else writers.write_parquet)(
            df, f"{tmp_path}/{name}.{'csv' if name == 'otb' else 'parquet'}")
    spec = {"version": 1, "sources": {"otb": "otb.csv", "hotels": "hotels.parquet",
                                      "city_events": "city_events.parquet"}, "steps": [*CLEAN, ONE_PER_DAY, SAFE]}
    (tmp_path / "specs").mkdir()
    (tmp_path / "specs" / "m.yaml").write_text(yaml.safe_dump(spec))
    assert load_spec(str(tmp_path / "specs" / "m.yaml")) == spec
    built = build_models(spark, load_models(str(tmp_path / "specs")), base_dir=str(tmp_path))
    assert built[0].results[-1].provenance["result_rows"] == 14
    (tmp_path / "specs" / "sub").mkdir()
    (tmp_path / "specs" / "sub" / "m.yaml").write_text("steps: []")
    with pytest.raises(ValueError, match="both name the model"):
        load_models(str(tmp_path / "specs"))
    assert readers.load_table(spark, f"{tmp_path}/otb.csv").schema["stay_date"].dataType.simpleString() == "date"


def test_every_step_op_measures_what_it_did(spark):
    from registry.specs import SHAPED

    days = spark.createDataFrame(
        [(1, "a", 5.0, 1), (1, "a", None, 2), (2, "b", 7.0, 3), (2, None, 1.0, 4), (None, "a", 9.0, 5)], "k int, g string, v double, t int")
    marks = spark.createDataFrame([(1, 2, "x"), (2, 9, "y")], "k int, u int, what string")
    steps = [
        {"id": "some", "op": "filter", "input": "days", "where": "t < 5 AND g <> 'z'"},
        {"id": "more", "op": "derive", "input": "some", "columns": {"v": "v * 2", "half": "v / 2"}, "expect": {"result_rows": 3}},
        {"id": "full", "op": "impute", "input": "more", "column": "v", "by": ["g"], "rule": "max"},
        {"id": "met", "op": "asof", "left": "full", "right": "marks", "keys": ["k"], "left_time": "t", "right_time": "u"},
        {"id": "one", "op": "dedupe", "input": "met", "keys": ["k"], "order": ["-t"], "rules": {"half": "first"}, "grain": ["k"],
         "expect": {"rows_dropped": 0}},
    ]
    spec = {"sources": {"days": "d.parquet", "marks": "m.parquet"}, "steps": steps}
    found = run_spec(spark, spec, tables={"days": days, "marks": marks})
    by = {r.id: r for r in found}
    assert by["some"].provenance["rows_dropped"] == 2  # a condition that is null keeps no row
    assert by["more"].provenance["columns"] == ["half", "v"] and by["more"].df.columns == ["k", "g", "v", "t", "half"]
    assert (by["full"].provenance["n_missing"], by["full"].provenance["n_filled"]) == (1, 1)
    assert by["met"].provenance["matched_left"] == 1 and by["met"].df.columns == ["k", "g", "v", "t", "half", "u", "what"]
    assert sorted(map(tuple, by["one"].df.collect())) == [(1, "a", 10.0, 2, 2.5, 2, "x"), (2, "b", 14.0, 3, 3.5, None, None)]
    assert by["one"].drift == {"rows_dropped": {"expected": 0, "actual": 1}} and by["one"].outcome["flags"] == []
    assert {o.output: o.column for o in by["more"].origins}["half"] is None
    for bad in ("t IN (SELECT k FROM other)", "reflect('a', 'b') = 'c'", "input_file_name() = ''", "1 = 1) UNION SELECT (1"):
        with pytest.raises(Exception):
            run_spec(spark, {"sources": {"days": "d"}, "steps": [{"id": "x", "op": "filter", "input": "days", "where": bad}]},
                     tables={"days": days})
    with pytest.raises(ValueError, match="no single statement"):
        from tallyframe.plans import ctas

        ctas.select_sql(found)
    assert {s["op"] for s in SHAPED["steps"]} == {"filter", "derive", "impute", "asof", "dedupe"}


def test_a_run_written_twice_is_there_once(spark, tables, tmp_path):
    metrics = run_metrics(spark, "r1", "m", run(spark, tables, CLEAN))
    for _ in range(2):
        append_metrics(metrics, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == metrics.count()


def test_a_failed_write_leaves_the_former_table(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t.parquet")
    writers.write_parquet(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        writers.write_parquet(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    # a table may be written from itself
    writers.write_parquet(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.parquet"]


def test_measured_steps_are_computed_once(spark, tables, monkeypatch):
    from tallyframe.operators import outcome

    written = []
    pin_counted = outcome.pin_counted
    monkeypatch.setattr(outcome, "pin_counted", lambda df: written.append(df.columns) or pin_counted(df))
    monkeypatch.setattr(outcome, "count_non_null", lambda df: pytest.fail("counted by a job of its own") if len(df.columns) > 8 else
                        outcome.counted_from(outcome.positional(df).agg(*outcome.non_null_aggregates(df.columns)).first().asDict(), df.columns))
    results = run(spark, tables, [*CLEAN, ONE_PER_DAY, SAFE])
    assert len(written) == sum(r.op != "normalize" for r in results)
