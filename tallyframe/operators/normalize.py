"""Rewrite columns in place and count what that did, failures above all.

All counts of a chain of transforms come from one aggregate: each transform is an
expression over the one before it, so nothing is replaced before it was counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions import kinds
from tallyframe.functions.evidence import plain
from tallyframe.functions.text import count_where, parse_double, strip_spaces
from tallyframe.operators.keys import named

FAILED_SAMPLES = 5
OPS = ("strip", "lower", "to_numeric", "to_string")
PROVENANCE_KEYS = frozenset({"op", "input_rows", "transforms", "flags"})


@dataclass(frozen=True)
class _Stage:
    """One transform: the column before, the column after, and its conversion."""

    position: int
    column: str
    op: str
    before: Column
    before_type: T.DataType
    converted: Column
    after: Column


def _convert(op: str, c: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    text = kinds.as_text(c, dtype)
    if op == "strip":
        return strip_spaces(text), T.StringType()
    if op == "lower":
        return F.lower(text), T.StringType()
    if op == "to_string":
        return text, T.StringType()
    kind = kinds.kind_of(dtype)
    if kind in kinds.RANGED or kind == kinds.BOOLEAN:
        return c.cast("double"), T.DoubleType()
    return parse_double(text), T.DoubleType()


@dataclass
class Normalized:
    """The rewritten table, still lazy, and the counts it owes."""

    df: DataFrame
    source: DataFrame
    stages: list[_Stage]

    @property
    def changed_columns(self) -> set[str]:
        return {s.column for s in self.stages}

    def aggregates(self) -> list[Column]:
        """Counts of every transform, to be taken over the source in one pass."""
        out = [F.count(F.lit(1)).alias("input_rows")]
        for s in self.stages:
            text = kinds.as_text(s.before, s.before_type)
            if s.op == "to_numeric":
                failed = s.before.isNotNull() & s.converted.isNull()
                out.append(F.count(s.converted).alias(f"converted{s.position}"))
                out.append(count_where(failed).alias(f"failed{s.position}"))
            elif s.op == "to_string":
                out.append(F.count(s.before).alias(f"changed{s.position}"))
            else:
                out.append(count_where(text != s.converted).alias(f"changed{s.position}"))
        return out

    def counts(self) -> DataFrame:
        return self.source.agg(*self.aggregates())

    def report(self) -> DataFrame:
        """One row per transform: ``position, column, op, n_changed, n_converted, n_failed``."""
        null = F.lit(None).cast("bigint")
        rows = [
            F.struct(
                F.lit(s.position).alias("position"),
                F.lit(s.column).alias("column"),
                F.lit(s.op).alias("op"),
                (null if s.op == "to_numeric" else F.col(f"changed{s.position}")).alias("n_changed"),
                (F.col(f"converted{s.position}") if s.op == "to_numeric" else null).alias(
                    "n_converted"
                ),
                (F.col(f"failed{s.position}") if s.op == "to_numeric" else null).alias("n_failed"),
            )
            for s in self.stages
        ]
        return self.counts().select("input_rows", F.inline(F.array(*rows)))

    def failed_values(self, position: int) -> DataFrame:
        """The smallest few values that would not convert, repeats included."""
        s = self.stages[position]
        failed = s.before.isNotNull() & s.converted.isNull()
        values = self.source.where(failed).select(s.before.alias("value"))
        return values.orderBy(F.col("value").asc_nulls_last()).limit(FAILED_SAMPLES)

    def provenance(self, counts: dict | None = None) -> dict:
        counts = counts or self.counts().first().asDict()
        records = []
        for s in self.stages:
            record = {"column": s.column, "op": s.op}
            if s.op == "to_numeric":
                record["n_converted"] = counts[f"converted{s.position}"]
                record["n_failed"] = counts[f"failed{s.position}"]
                if record["n_failed"]:
                    failed = self.failed_values(s.position).collect()
                    record["sample_failed"] = [plain(r["value"]) for r in failed]
            else:
                record["n_changed"] = counts[f"changed{s.position}"]
            records.append(record)
        return {
            "op": "normalize",
            "input_rows": counts["input_rows"],
            "transforms": records,
            "flags": ["coercion_failures"] if any(r.get("n_failed") for r in records) else [],
        }


def apply_normalize(df: DataFrame, transforms: list[dict]) -> Normalized:
    """Apply ``{"column", "op", "fill"?}`` transforms in order, keeping column order."""
    current = {f.name: (named(df, f.name), f.dataType) for f in df.schema.fields}
    stages = []
    for position, transform in enumerate(transforms):
        column, op = transform["column"], transform["op"]
        if column not in current:
            raise ValueError(f"normalize: the table has no column {column!r}")
        if op not in OPS:
            raise ValueError(f"normalize: {op!r} is not one of {list(OPS)}")
        before, dtype = current[column]
        converted, after_type = _convert(op, before, dtype)
        after = converted
        if op == "to_numeric" and transform.get("fill") is not None:
            after = F.coalesce(converted, F.lit(float(transform["fill"])))
        stages.append(_Stage(position, column, op, before, dtype, converted, after))
        current[column] = (after, after_type)
    out = df.select(*[c.alias(name) for name, (c, _) in current.items()]) if stages else df
    return Normalized(out, df, stages)
