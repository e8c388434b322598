"""Rollups of event logs: counts per log, calls per tool, tokens, call labels.

Every rollup is a grouped aggregate with map-side combining, or one row per event;
no log is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.text import count_where
from tallyframe.sources.eventlog import HEADER

PART_CHARS = 24
SUBJECT_CHARS = 48

# The three usage fields that together are everything sent.
INPUT_FIELDS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")

_DATA = (
    "text string, model string, effort string, name string, input string, is_error boolean, "
    "questions array<string>, allowed boolean, session_id string, subtype string, "
    "cost_usd double, usage string, started string, kind string, prompt string"
)
_USAGE = ", ".join(f"{f} bigint" for f in (*INPUT_FIELDS, "output_tokens"))


def parsed(events: DataFrame) -> DataFrame:
    """Events with their data read into ``d`` and their token usage into ``u``."""
    read = events.withColumn("d", F.from_json("data", _DATA))
    usage = F.when(~F.col("d.usage").rlike(r"^\s*\{\s*\}\s*$"), F.from_json("d.usage", _USAGE))
    return read.withColumn("u", usage)


def tool_label(name: Column) -> Column:
    """A tool's own name, its server prefix removed."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^mcp__.*?__", "")


def _tokens() -> list[Column]:
    """Null where no usage was reported, which is not the same as nothing sent."""
    u, zero = F.col("u"), F.lit(0).cast("bigint")
    sent = sum((F.coalesce(u[f], zero) for f in INPUT_FIELDS[1:]), F.coalesce(u[INPUT_FIELDS[0]], zero))
    result = F.col("kind") == "result"
    return [
        F.sum(F.when(result & u.isNotNull(), sent)).alias("input_tokens"),
        F.sum(F.when(result & u.isNotNull(), F.coalesce(u["cache_read_input_tokens"], zero))).alias(
            "cached_tokens"),
        F.sum(F.when(result, u["output_tokens"])).alias("output_tokens"),
    ]


def token_totals(events: DataFrame) -> DataFrame:
    return parsed(events).groupBy("log").agg(*_tokens())


def log_summary(events: DataFrame) -> DataFrame:
    """One row of counts per log, and how it opened and ended."""
    kind, d = F.col("kind"), F.col("d")
    is_a = lambda k: kind == k
    first = lambda value, where: F.min_by(F.when(where, value), F.when(where, F.col("seq")))
    last = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("seq")))
    prompts = count_where(is_a("prompt"))
    header = lambda field: F.max(F.when(is_a(HEADER), d[field]))
    opened = lambda field, fallback: F.when(
        prompts > 0, first(d[field], is_a("prompt"))).otherwise(header(fallback))
    done = is_a("result")
    allowed = count_where(is_a("approval_result") & F.coalesce(d["allowed"], F.lit(False)))
    writes = count_where(is_a("approval_result"))
    return parsed(events).groupBy("log").agg(
        header("started").alias("started"),
        opened("model", "model").alias("model"),
        opened("effort", "effort").alias("effort"),
        F.when(prompts > 0, prompts).when(count_where(~is_a(HEADER)) > 0, 1).otherwise(0)
        .cast("bigint").alias("exchanges"),
        opened("text", "prompt").alias("prompt"),
        last(d["session_id"], done & (d["session_id"] != "")).alias("session_id"),
        count_where(is_a("tool_call")).alias("tools"),
        count_where(is_a("tool_result") & d["is_error"]).alias("tool_errors"),
        count_where(is_a("question")).alias("asked"),
        F.coalesce(F.sum(F.when(is_a("question"), F.size(F.coalesce(d["questions"], F.array())))),
                   F.lit(0)).cast("bigint").alias("questions"),
        writes.alias("writes"),
        allowed.alias("approved"),
        (writes - allowed).alias("refused"),
        last(d["subtype"], done).alias("subtype"),
        F.sum(F.when(done, d["cost_usd"])).alias("cost_usd"),
        *_tokens(),
    )


def tool_tally(events: DataFrame) -> DataFrame:
    """``log, tool, n``: calls per tool."""
    calls = parsed(events).where(F.col("kind") == "tool_call")
    return calls.groupBy("log", tool_label(F.col("d.name")).alias("tool")).agg(
        F.count(F.lit(1)).alias("n")
    )


def models_used(events: DataFrame) -> DataFrame:
    """``log, model, first_seq``: each model a log ran on, with where it first did.

    A log without prompts names its model in its header.
    """
    named = parsed(events).where(F.col("kind").isin("prompt", HEADER) & (F.col("d.model") != ""))
    seen = named.groupBy("log", F.col("d.model").alias("model")).agg(
        F.min(F.when(F.col("kind") == "prompt", F.col("seq"))).alias("first_seq"),
        F.min("seq").alias("any_seq"),
    )
    prompted = seen.where(F.col("first_seq").isNotNull()).select("log").distinct()
    from_header = seen.where(F.col("first_seq").isNull()).join(prompted, "log", "left_anti")
    return seen.where(F.col("first_seq").isNotNull()).drop("any_seq").unionByName(
        from_header.select("log", "model", F.col("any_seq").alias("first_seq"))
    )


def clip(text: Column, chars: int) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(
        F.concat(F.left(text, F.lit(chars - 1)), F.lit("…"))
    )


def call_labels(events: DataFrame, skip_keys=()) -> DataFrame:
    """``log, seq, label``: each call as ``tool(subject)``, in the order of ``seq``.

    The subject is the call's text arguments joined, or the sizes of its list
    arguments when it has none.
    """
    calls = parsed(events).where(F.col("kind") == "tool_call").select(
        "log", "seq", tool_label(F.col("d.name")).alias("tool"),
        F.map_entries(F.from_json("d.input", "map<string,variant>")).alias("entries"),
    )
    kept = F.filter("entries", lambda e: ~e["key"].isin(*skip_keys)) if skip_keys else F.col("entries")
    kind = lambda e: F.schema_of_variant(e["value"])
    text = lambda e: F.try_variant_get(e["value"], "$", "string")
    texts = F.transform(
        F.filter(kept, lambda e: (kind(e) == "STRING") & (text(e) != "")),
        lambda e: clip(text(e), PART_CHARS),
    )
    lists = F.transform(
        F.filter(kept, lambda e: kind(e).startswith("ARRAY")),
        lambda e: F.concat(
            F.size(F.try_variant_get(e["value"], "$", "array<variant>")).cast("string"),
            F.lit(" "), e["key"]),
    )
    subject = F.when(F.size(texts) > 0, F.array_join(texts, ".")).otherwise(F.array_join(lists, ", "))
    clipped = F.coalesce(clip(subject, SUBJECT_CHARS), F.lit(""))
    label = F.when(clipped != "", F.concat("tool", F.lit("("), clipped, F.lit(")"))).otherwise(
        F.col("tool"))
    return calls.select("log", "seq", label.alias("label"))
