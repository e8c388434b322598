"""Fill missing values from the other rows of the same group, exactly.

Means come from one aggregate. Medians and modes come from the counts of every distinct
value in its group: a mode is the value with most rows, a median is found where the
running sum of the counts passes the middle. The counts are ordered over range-partitioned
cells, so a group that holds a third of all rows, or of all values, is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import kinds
from tallyframe.operators import keys as K
from tallyframe.operators.ordered import running_sums
from tallyframe.session import pin

RULES = ("mean", "median", "mode", "min", "max")


@dataclass
class Imputed:
    """The filled table, the value of every group, and what was missing."""

    df: DataFrame
    fills: DataFrame
    column: str
    by: tuple[str, ...]
    rule: str
    source: DataFrame

    def report(self) -> DataFrame:
        """One row: rows, missing values, those filled, those left, and groups without any value."""
        return self._counted().select("n_rows", "n_missing", "n_filled", (F.col("n_missing") - F.col("n_filled")).alias("n_left"),
                                      "n_groups", "n_groups_without")

    def _counted(self) -> DataFrame:
        missing = F.count_if(F.col("v").isNull())
        groups = _grouped(self.source, self.column, self.by).groupBy(*_names(self.by)).agg(
            F.count("*").alias("n"), missing.alias("m"))
        return groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_missing"),
            F.coalesce(F.sum(F.when(F.col("m") < F.col("n"), F.col("m"))), F.lit(0)).alias("n_filled"),
            F.count("*").alias("n_groups"), F.count_if(F.col("m") == F.col("n")).alias("n_groups_without"))

    def provenance(self) -> dict:
        return {"op": "impute", "column": self.column, "by": list(self.by), "rule": self.rule,
                **self.report().first().asDict(), "flags": []}


def impute(df: DataFrame, column: str, by=(), rule: str = "median") -> Imputed:
    """Null values of ``column`` filled with the mean, median, mode, least or largest of their group.

    A median lies between the two middle values if their number is even. A mode that ties
    is the smaller value. Groups are the distinct values of ``by``, null being one of them;
    without ``by`` all rows are one group. A group without a value stays null. Mean and
    median make an integer column double; other types keep theirs.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {list(RULES)}")
    absent = [c for c in (column, *by) if c not in df.columns]
    if absent:
        raise ValueError(f"the table lacks column(s): {absent}")
    if column in by:
        raise ValueError(f"{column!r} cannot be filled by its own groups")
    kind = kinds.kind_of(df.schema[column].dataType)
    if rule in ("mean", "median") and kind not in (kinds.INTEGER, kinds.FLOAT):
        raise ValueError(f"a {rule} needs numbers; {column!r} holds {kind}")
    fills = pin(_fills(df, column, by, rule))
    names = _names(by)
    right = fills.select(*[F.col(n).alias(f"__{n}") for n in names], F.col("fill").alias("__fill"))
    if by:
        joined = df.join(right, reduce(and_, [K.named(df, c).eqNullSafe(right[f"__{n}"]) for c, n in zip(by, names)]), "left")
    else:
        row = fills.first()
        joined = df.withColumn("__fill", F.lit(row.fill if row else None).cast(fills.schema["fill"].dataType))
    shown = [F.coalesce(F.col(_quoted(c)), F.col("__fill")).alias(c) if c == column else F.col(_quoted(c)) for c in df.columns]
    return Imputed(joined.select(*shown), fills, column, by, rule, df)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _names(by) -> list[str]:
    return [f"g{i}" for i in range(max(1, len(by)))]


def _grouped(df: DataFrame, column: str, by) -> DataFrame:
    groups = [K.named(df, c) for c in by] or [F.lit(0)]  # without groups all rows are one
    return df.select(*[c.alias(n) for c, n in zip(groups, _names(by))], K.named(df, column).alias("v"))


def _fills(df: DataFrame, column: str, by, rule: str) -> DataFrame:
    """``g*, fill``: the value of every group that has any."""
    groups, rows = _names(by), _grouped(df, column, by).where("v IS NOT NULL")
    if rule in ("mean", "min", "max"):
        value = {"mean": F.avg, "min": F.min, "max": F.max}[rule]("v")
        return rows.groupBy(*groups).agg(value.alias("fill")).where("fill IS NOT NULL")
    counts = rows.groupBy(*groups, "v").agg(F.count("*").alias("n"))
    if rule == "mode":
        return counts.groupBy(*groups).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("fill"))
    run = running_sums(counts, groups, ["v"], {"upto": "n"})
    total = run.groupBy(*groups).agg(F.max("upto").alias("rows"))
    totals = total.select(*[F.col(g).alias(f"t{g}") for g in groups], "rows")
    placed = run.join(totals, reduce(and_, [run[g].eqNullSafe(totals[f"t{g}"]) for g in groups]))
    # the values that stand at the two middle places; one and the same if the number is odd
    low, high = F.floor((F.col("rows") + 1) / 2), F.floor(F.col("rows") / 2) + 1
    first = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v").cast("double")))
    return placed.groupBy(*groups).agg(((first(low) + first(high)) / 2).alias("fill"))
