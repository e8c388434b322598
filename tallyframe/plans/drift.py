"""What changed between two runs: fields by what kind of claim they are, and distributions.

An invariant (a relationship, a key's uniqueness, a type, a flag) either holds as before or
does not. A measure (a count, a rate) moves, by a distance. A distribution moves by the
share of rows that would have to change their value, taken from exact counts of every
value on both sides.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.functions import kinds
from tallyframe.operators.keys import named
from tallyframe.session import small_frame

# Fields that state a property of a table or join rather than its size, by their last part.
INVARIANTS = ("relationship", "key_dtype_match", "unique", "how", "keys", "op", "kind", "dtype", "flags", "matches_prediction")
KEYS = ("model", "step", "part", "field")
LONG_VALUE = 64


def drift_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``model, step, part, field, class, before, after, distance`` of every field of two runs that differs.

    Both are metrics tables of one run each. ``class`` is ``invariant``, ``measure`` (both
    values are numbers) or ``text``; a field that only one run has is ``gone`` or ``new``. The
    distance of a measure is its change over the larger of the two, between 0 and 2; that
    of anything else is 1. A field that occurs several times in a run is compared by its
    sorted values.
    """
    side = lambda df, name: df.groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_list("value")), "\x1f").alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(before, "before").join(side(after, "after"), list(KEYS), "full")
    changed = both.where(~F.col("before").eqNullSafe(F.col("after")))
    a, b = F.expr("try_cast(before AS double)"), F.expr("try_cast(after AS double)")
    larger = F.greatest(F.abs(a), F.abs(b))
    last = F.element_at(F.split(F.regexp_replace("field", r"\[[0-9]+\]", ""), r"\."), -1)
    kind = (F.when(F.col("in_after").isNull(), "gone").when(F.col("in_before").isNull(), "new")
            .when(F.col("part").isin("blocking", "acknowledged") | last.isin(*INVARIANTS), "invariant")
            .when(a.isNotNull() & b.isNotNull(), "measure").otherwise("text"))
    return changed.withColumn("class", kind).withColumn(
        "distance", F.when(F.col("class") == "measure", F.abs(a - b) / larger).otherwise(F.lit(1.0))).select(
        *KEYS, "class", "before", "after", "distance")


def drift_frame(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """Expected against measured ``(step, field, value)`` rows, where they differ."""
    e, m = expected.alias("e"), measured.alias("m")
    joined = e.join(m, ["step", "field"], "left")
    return joined.where(~F.col("e.value").eqNullSafe(F.col("m.value"))).select(
        "step", "field", F.col("e.value").alias("expected"), F.col("m.value").alias("actual")
    )


def step_drift(spark: SparkSession, step: str, expect: dict | None, measured: dict) -> dict:
    """By field, what a step was expected to measure and what it did: the rows of ``drift_frame``, for showing."""
    if not expect:
        return {}
    rows = lambda of: small_frame(
        spark, [(step, name, json.dumps(of.get(name), sort_keys=True)) for name in expect], "step string, field string, value string")
    found = drift_frame(rows(expect), rows(measured)).collect()  # of the fields named in one step
    return {r.field: {"expected": json.loads(r.expected), "actual": json.loads(r.actual)} for r in found}


def value_histograms(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n``: how many rows hold each value, nulls included. Histograms of parts of a table add up.

    Text beyond 64 bytes is told apart by its digest.
    """
    names = columns or df.columns
    cells = [F.struct(F.lit(c).alias("column"), _text(named(df, c), df.schema[c].dataType).alias("value")) for c in names]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("*").alias("n"))


def _text(column, dtype):
    text = kinds.as_text(column, dtype)
    return F.when(F.octet_length(text) > LONG_VALUE, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def merged(histograms: list[DataFrame]) -> DataFrame:
    """The histogram of several parts together."""
    return reduce(DataFrame.unionByName, histograms).groupBy("column", "value").agg(F.sum("n").alias("n"))


def distribution_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row per column of two histograms: rows and values of both, values gone and new, rows that hold new values, distance.

    ``distance`` is the total variation between both shares of values: 0 for the same
    distribution, 1 for no value in common. A column without rows on one side has null.
    """
    b, a = (h.select("column", "value", F.col("n").alias(name)) for h, name in ((before, "b"), (after, "a")))
    met = b.join(a, (b["column"] == a["column"]) & b["value"].eqNullSafe(a["value"]), "full").select(
        F.coalesce(b["column"], a["column"]).alias("column"), "b", "a")
    totals = met.groupBy("column").agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))
    share = lambda n, rows: F.coalesce(F.col(n), F.lit(0)) / F.col(rows)
    zero = F.lit(0).cast("bigint")
    return met.join(totals, "column").groupBy("column").agg(
        F.coalesce(F.first("rows_before"), zero).alias("rows_before"), F.coalesce(F.first("rows_after"), zero).alias("rows_after"),
        F.count("b").alias("values_before"), F.count("a").alias("values_after"),
        F.count_if(F.col("a").isNull()).alias("values_gone"), F.count_if(F.col("b").isNull()).alias("values_new"),
        F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("a"))), zero).alias("rows_new"),
        (F.sum(F.abs(share("b", "rows_before") - share("a", "rows_after"))) / 2).alias("distance"))
