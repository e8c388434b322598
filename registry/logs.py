"""Event-log rollups, over events that Spark writes out of the conversations.

A user turn is a prompt; an assistant turn is a tool call or, every other length,
the result that ends an exchange. One conversation is one log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from registry.common import read
from tallyframe.operators import logrollup as R
from tallyframe.session import run_dir
from tallyframe.sources.eventlog import HEADER, read_events


def events(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    size = F.length("text")
    call = (F.col("role") != "user") & (size % 2 == 0)
    data = (
        F.when(F.col("role") == "user", F.to_json(F.struct(
            F.col("text"), F.concat(F.lit("m"), (size % 3).cast("string")).alias("model"))))
        .when(call, F.to_json(F.struct(
            F.concat(F.lit("mcp__tools__tool_"), (size % 5).cast("string")).alias("name"),
            F.struct(F.when(size % 3 > 0, F.col("text")).alias("text"),
                     F.array(F.lit(1), F.lit(2)).alias("pairs")).alias("input"))))
        .otherwise(F.to_json(F.struct(
            F.when(size % 3 == 0, "done").otherwise("stopped").alias("subtype"),
            (size * 0.25).alias("cost_usd"),
            F.when(size % 5 > 0, F.struct(
                size.cast("bigint").alias("input_tokens"), F.col("turn").alias("cache_read_input_tokens"),
                F.lit(3).cast("bigint").alias("output_tokens"))).alias("usage"))))
    )
    kind = F.when(F.col("role") == "user", "prompt").when(call, "tool_call").otherwise("result")
    return turns.select(F.col("conv_id").alias("log"), F.col("turn").alias("seq"),
                        kind.alias("kind"), data.alias("data"))


def written_logs(spark, sf_dir) -> DataFrame:
    """A JSONL file per conversation, written and read back: a header, then an event per turn of every kind there is.

    Lines that are no events stand among them and are passed over.
    """
    turns = read(spark, sf_dir, "conversations")
    size, at = F.length("text"), F.col("turn") % 6
    event = lambda kind, **data: F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*[v.alias(k) for k, v in data.items()]).alias("data")))
    line = (
        F.when(at == 0, event("prompt", text=F.col("text"), model=F.concat(F.lit("m"), (size % 3).cast("string")), effort=F.lit("high")))
        .when(at == 1, event("tool_call", name=F.lit("mcp__files__look"), input=F.struct(F.col("role").alias("path"))))
        .when(at == 2, event("tool_result", is_error=size % 2 == 0))
        .when(at == 3, event("question", questions=F.array_repeat(F.lit("why?"), (size % 4).cast("int"))))
        .when(at == 4, event("approval_result", allowed=size % 3 > 0))
        .otherwise(event("result", session_id=F.concat(F.lit("s"), F.col("turn").cast("string")), subtype=F.lit("done"), cost_usd=size * 0.5)))
    header = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), event(HEADER, started=F.concat(F.lit("day "), F.col("n").cast("string"))).alias("value"))
    lines = header.unionByName(turns.select("conv_id", "turn", line.alias("value"))).unionByName(
        turns.where("turn = 0").select("conv_id", "turn", F.lit('{"kind": "prompt", "da').alias("value")))
    path = f"{run_dir(spark)}/logs-{uuid.uuid4().hex}"
    # whole logs go to a task each, in order; a file is one log
    lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value").write.partitionBy("conv_id").text(path)
    read_back = read_events(spark, path)
    return read_back.withColumn("log", F.regexp_extract("log", r"conv_id=(-?\d+)", 1).cast("bigint"))


def log_files_summary(spark, sf_dir):
    return R.log_summary(written_logs(spark, sf_dir)).select(
        "log", "started", "model", "effort", "exchanges", "session_id", "tools", "tool_errors", "asked", "questions",
        "writes", "approved", "refused", "subtype", F.round("cost_usd", 4).alias("cost_usd"))


def log_files_events(spark, sf_dir):
    """How many events of each kind were read."""
    return written_logs(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def log_summary(spark, sf_dir):
    return R.log_summary(events(spark, sf_dir)).select(
        "log", "model", "exchanges", "prompt", "tools", "writes", "subtype",
        F.round("cost_usd", 4).alias("cost_usd"), "input_tokens", "cached_tokens", "output_tokens")


def log_call_labels(spark, sf_dir):
    return R.call_labels(events(spark, sf_dir))


QUERIES = {
    "log_files_summary": log_files_summary,
    "log_files_events": log_files_events,
    "log_summary": log_summary,
    "log_tool_tally": lambda spark, sf_dir: R.tool_tally(events(spark, sf_dir)),
    "log_token_totals": lambda spark, sf_dir: R.token_totals(events(spark, sf_dir)),
    "log_models_used": lambda spark, sf_dir: R.models_used(events(spark, sf_dir)),
    "log_call_labels": log_call_labels,
}

_E = """(SELECT conv_id AS log, turn AS seq, role, text, length(text) AS size,
    CASE WHEN role = 'user' THEN 'prompt' WHEN length(text) % 2 = 0 THEN 'tool_call' ELSE 'result' END AS kind
    FROM conversations)"""
_TOKENS = """sum(size + seq) FILTER (WHERE kind = 'result' AND size % 5 > 0)::BIGINT AS input_tokens,
    sum(seq) FILTER (WHERE kind = 'result' AND size % 5 > 0)::BIGINT AS cached_tokens,
    sum(3) FILTER (WHERE kind = 'result' AND size % 5 > 0)::BIGINT AS output_tokens"""

ORACLES = {
    "log_files_summary": """
        WITH t AS (SELECT conv_id, turn, length(text) AS size, turn % 6 AS part FROM conversations)
        SELECT conv_id AS log, 'day ' || count(*) AS started,
               'm' || (arg_min(size, turn) FILTER (part = 0) % 3) AS model, CASE WHEN count(*) FILTER (part = 0) > 0 THEN 'high' END AS effort,
               CASE WHEN count(*) FILTER (part = 0) > 0 THEN count(*) FILTER (part = 0) ELSE 1 END AS exchanges,
               's' || (max(turn) FILTER (part = 5)) AS session_id, count(*) FILTER (part = 1) AS tools,
               count(*) FILTER (part = 2 AND size % 2 = 0) AS tool_errors, count(*) FILTER (part = 3) AS asked,
               coalesce(sum(size % 4) FILTER (part = 3), 0)::BIGINT AS questions, count(*) FILTER (part = 4) AS writes,
               count(*) FILTER (part = 4 AND size % 3 > 0) AS approved, count(*) FILTER (part = 4 AND size % 3 = 0) AS refused,
               CASE WHEN count(*) FILTER (part = 5) > 0 THEN 'done' END AS subtype, round(sum(size * 0.5::DOUBLE) FILTER (part = 5), 4) AS cost_usd
        FROM t GROUP BY conv_id""",
    "log_files_events": """
        SELECT CASE turn % 6 WHEN 0 THEN 'prompt' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool_result' WHEN 3 THEN 'question'
                    WHEN 4 THEN 'approval_result' ELSE 'result' END AS kind, count(*) AS n FROM conversations GROUP BY 1
        UNION ALL SELECT 'header', count(DISTINCT conv_id) FROM conversations""",
    "log_summary": f"""SELECT log, 'm' || (arg_min(size, seq) FILTER (WHERE kind = 'prompt') % 3) AS model,
        CASE WHEN count(*) FILTER (WHERE kind = 'prompt') > 0 THEN count(*) FILTER (WHERE kind = 'prompt') ELSE 1 END AS exchanges,
        arg_min(text, seq) FILTER (WHERE kind = 'prompt') AS prompt,
        count(*) FILTER (WHERE kind = 'tool_call') AS tools, 0 AS writes,
        CASE (arg_max(size, seq) FILTER (WHERE kind = 'result')) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'stopped'
             WHEN 2 THEN 'stopped' END AS subtype,
        round(sum(size * 0.25::DOUBLE) FILTER (WHERE kind = 'result'), 4) AS cost_usd, {_TOKENS} FROM {_E} GROUP BY log""",
    "log_tool_tally": f"""SELECT log, 'tool_' || (size % 5) AS tool, count(*) AS n FROM {_E}
        WHERE kind = 'tool_call' GROUP BY ALL""",
    "log_token_totals": f"SELECT log, {_TOKENS} FROM {_E} GROUP BY log",
    "log_models_used": f"""SELECT log, 'm' || (size % 3) AS model, min(seq) AS first_seq FROM {_E}
        WHERE kind = 'prompt' GROUP BY ALL""",
    "log_call_labels": f"""SELECT log, seq, 'tool_' || (size % 5) || CASE WHEN size % 3 > 0 AND text <> '' THEN
        '(' || CASE WHEN size <= 24 THEN text ELSE left(text, 23) || '…' END || ')' ELSE '(2 pairs)' END AS label
        FROM {_E} WHERE kind = 'tool_call'""",
}
