import datetime as dt
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tallyframe.functions.evidence import plain
from tallyframe.operators import logrollup as R
from tallyframe.operators.profile import profile
from tallyframe.sources import eventlog, files, readers, table, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_come_from_every_row(spark, tmp_path):
    body = "id,amount,day,at,ok,mixed,empty,code\n" + "".join(
        f"{i},{'N/A' if i == 3 else i / 2},2026-01-0{i},2026-01-0{i} 10:00:0{i}.25,{'true' if i % 2 else 'FALSE'},"
        f"{i if i < 5 else 'x'},{'NULL' if i % 2 else ''},00{i}\n" for i in range(1, 6))
    df = readers.load_table(spark, write(tmp_path / "t.csv", body))
    assert table.schema_of(df) == {
        "id": "bigint", "amount": "double", "day": "date", "at": "timestamp_ntz", "ok": "boolean",
        "mixed": "string", "empty": "string", "code": "string"}  # 001 is a code, not the number 1
    assert df.where("amount IS NULL").count() == 1 and df.where("empty IS NOT NULL").count() == 0


@pytest.mark.parametrize("token", readers.NA_TOKENS)
def test_missing_value_texts(spark, tmp_path, token):
    path = write(tmp_path / "na.csv", f"a,b\n1,x\n{token},y\n")
    assert rows_of(readers.read_csv(spark, path, types={"a": "bigint", "b": "string"})) == [
        "Row(a=1, b='x')", "Row(a=None, b='y')"]


def test_other_texts_are_not_missing(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a\nnone\n-\n"N / A"\n')
    assert readers.load_table(spark, path).where("a IS NULL").count() == 0


def test_codes_and_very_long_integers_stay_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,long,n,signed\n00123,12345678901234567890,12,-7\n456,1,0,+8\n")
    table = readers.load_table(spark, str(tmp_path / "c.csv"))
    assert dict(table.dtypes) == {"code": "string", "long": "string", "n": "bigint", "signed": "bigint"}
    assert table.first()["code"] == "00123"


def test_two_hundred_columns_are_typed_in_one_pass(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(f"c{i}" for i in range(200)) + "\n" + ",".join(str(i) for i in range(200)) + "\n")
    assert {t for _, t in readers.load_table(spark, str(tmp_path / "w.csv")).dtypes} == {"bigint"}


def test_quotes_spaces_and_commas_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, "  padded "), (3, "back\\slash"), (4, None)],
                               "id bigint, text string")
    path = writers.write_table(df, str(tmp_path / "out.csv"))
    assert rows_of(readers.load_table(spark, path)) == rows_of(df)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n')
    assert readers.read_csv(spark, path, multi_line=True).first()["b"] == "x\ny"


def test_microseconds_survive_csv(spark, tmp_path):
    at = dt.datetime(2026, 1, 1, 10, 0, 0, 123456)
    df = spark.createDataFrame([(at,)], "at timestamp_ntz")
    assert readers.load_table(spark, writers.write_table(df, str(tmp_path / "o.csv"))).first()["at"] == at


def test_csv_and_parquet_profile_alike(spark, bookings, tmp_path):
    csv = writers.write_table(bookings, str(tmp_path / "b.csv"))
    parquet = writers.write_table(bookings, str(tmp_path / "b.parquet"))
    rounded = lambda df: [plain(r) for r in df.orderBy("position").collect()]
    assert rounded(readers.profile_path(spark, csv)) == rounded(readers.profile_path(spark, parquet))
    assert rounded(profile(bookings)) == rounded(readers.profile_path(spark, parquet))


def test_finding_files(spark, tmp_path):
    for name in ("b.csv", "a.parquet", "note.txt"):
        write(tmp_path / name, "x\n1\n")
    (tmp_path / "below").mkdir()
    write(tmp_path / "below" / "c.csv", "x\n1\n")
    names = lambda target: [f.rsplit("/", 1)[1] for f in files.find_data_files(spark, str(target))]
    assert names(tmp_path) == ["a.parquet", "b.csv"]
    assert names(tmp_path / "*.csv") == ["b.csv"] and names(tmp_path / "b.csv") == ["b.csv"]
    with pytest.raises(ValueError, match="no data files"):
        names(tmp_path / "*.orc")
    with pytest.raises(ValueError, match="supported: .csv, .parquet"):
        readers.load_table(spark, str(tmp_path / "note.txt"))
    assert list(readers.load_named(spark, [str(tmp_path / "b.csv")])) == ["b"]


def test_staleness(spark, tmp_path):
    paths = {n: write(tmp_path / f"{n}.csv", "x\n1\n") for n in ("same", "grown", "gone")}
    recorded = spark.createDataFrame(files.dataset_facts(spark, paths).collect())
    unrecorded = recorded.where("source = 'same'").withColumns(
        {"source": F.lit("quiet"), "size": F.lit(None).cast("bigint")})
    write(tmp_path / "grown.csv", "x\n1\n22\n")
    (tmp_path / "gone.csv").unlink()
    now = files.dataset_facts(spark, paths)
    found = files.stale_sources(recorded.unionByName(unrecorded), now).collect()
    assert {r["source"]: r["stale"] for r in found} == {
        "same": False, "grown": True, "gone": True, "quiet": False}


def test_file_facts_read_no_contents(spark, tmp_path):
    write(tmp_path / "a.csv", "x\n1\n")
    facts = files.file_facts(spark, str(tmp_path))
    assert facts.first()["size"] == 4
    scan = facts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in scan


def test_table_exits_are_capped(spark):
    df = spark.range(100).selectExpr("id", *[f"id AS c{i}" for i in range(20)])
    shown = table.preview(df)
    assert (shown["n_rows"], shown["n_cols"], len(shown["rows"]), len(shown["columns"])) == (100, 21, 15, 12)
    assert len(table.head(df)) == 10
    assert table.measure(df, {"n": "count(*)", "m": "max(id)"}) == {"n": 100, "m": 99}
    assert table.measure(df, {}) == {} and table.scalar(df, "sum(id)") == 4950
    assert table.derive(df, "id + 1 AS x").columns == ["x"]
    df.createOrReplaceTempView("hundred")
    assert table.from_name(spark, "hundred").count() == 100
    assert table.from_rows(spark, [(1,)], "a int").count() == 1


# --- event logs ---------------------------------------------------------------------


def event(what, **data):
    return {"kind": what, "data": data}


@pytest.fixture
def logs(spark, tmp_path):
    first = [event("header", started="t0", kind="chat"), event("prompt", text="hi", model="m1", effort="low"),
             event("tool_call", name="mcp__srv__graph_lookup", input={"table": "orders", "column": "city", "dir": "x"}),
             event("tool_call", name="measure", input={"pairs": [1, 2, 3], "flag": True}),
             event("tool_call", name="plain", input={}),
             event("tool_call", name="measure", input={"long": "a" * 30, "b": "b" * 30}),
             event("tool_result", is_error=True), event("tool_result", is_error=False),
             event("question", questions=[{"q": 1}, {"q": 2}]),
             event("approval_result", allowed=True), event("approval_result", allowed=False),
             event("result", subtype="ok", session_id="s", cost_usd=0.5,
                   usage={"input_tokens": 5, "cache_read_input_tokens": 7, "output_tokens": 3}),
             event("prompt", text="again", model="m2"), event("prompt", text="more", model="m1"),
             event("result", subtype="interrupted", usage={})]
    lines = [json.dumps(e) for e in first] + ["not json", "[1]", "", '{"kind": "tex']
    write(tmp_path / "a.jsonl", "\n".join(lines))
    write(tmp_path / "b.jsonl", "\n".join(map(json.dumps, [
        event("header", model="old", prompt="p"), event("text", text="x"), event("result", cost_usd=None)])))
    events = eventlog.read_events(spark, str(tmp_path))
    return events.withColumn("log", F.regexp_extract("log", r"([^/]+)\.jsonl$", 1))


def test_only_well_formed_lines_are_events(logs):
    assert logs.groupBy("log").count().orderBy("log").collect() == [("a", 15), ("b", 3)]


def test_log_summary(logs):
    a, b = R.log_summary(logs).orderBy("log").collect()
    assert (a["exchanges"], a["model"], a["prompt"], a["tools"], a["tool_errors"]) == (3, "m1", "hi", 4, 1)
    assert (a["asked"], a["questions"], a["writes"], a["approved"], a["refused"]) == (1, 2, 2, 1, 1)
    assert (a["subtype"], a["session_id"], a["cost_usd"]) == ("interrupted", "s", 0.5)
    assert (a["input_tokens"], a["cached_tokens"], a["output_tokens"]) == (12, 7, 3)
    # an older log names model and prompt in its header; nothing reported is not zero
    assert (b["exchanges"], b["model"], b["prompt"]) == (1, "old", "p")
    assert (b["cost_usd"], b["input_tokens"], b["output_tokens"]) == (None, None, None)


def test_tally_models_and_labels(logs):
    assert {(r["tool"], r["n"]) for r in R.tool_tally(logs).collect()} == {
        ("graph_lookup", 1), ("measure", 2), ("plain", 1)}
    used = R.models_used(logs).orderBy("log", "first_seq").collect()
    assert [(r["log"], r["model"]) for r in used] == [("a", "m1"), ("a", "m2"), ("b", "old")]
    labels = [r["label"] for r in R.call_labels(logs, ["dir"]).orderBy("seq").collect()]
    assert labels == ["graph_lookup(orders.city)", "measure(3 pairs)", "plain",
                      "measure(" + "a" * 23 + "…." + "b" * 22 + "…)"]
    assert R.token_totals(logs).where("log = 'a'").first()["input_tokens"] == 12
