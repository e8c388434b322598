"""Join keys: which columns, how they are compared, and how often each occurs.

A join is diagnosed from two tables of key multiplicities. Each side is reduced
to one row per distinct key before anything meets, so a key that holds a third
of all rows is one row here, and a result of any size is a sum of products.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import kinds


@dataclass(frozen=True)
class KeySpec:
    """Key columns of both sides, and whether they share their names."""

    left: tuple[str, ...]
    right: tuple[str, ...]
    shared: bool


def resolve_keys(on=None, left_on=None, right_on=None) -> KeySpec:
    """``on`` for shared names, else ``left_on`` with ``right_on``."""
    listed = lambda names: (names,) if isinstance(names, str) else tuple(names)
    if on is not None:
        return KeySpec(listed(on), listed(on), True)
    if left_on is None or right_on is None:
        raise ValueError("give `on`, or both `left_on` and `right_on`")
    left, right = listed(left_on), listed(right_on)
    if len(left) != len(right):
        raise ValueError(
            f"left_on {list(left)} and right_on {list(right)} differ in length"
        )
    return KeySpec(left, right, False)


def require_columns(df: DataFrame, names, side: str) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"the {side} table lacks key column(s): {absent}")


@dataclass(frozen=True)
class KeyPlan:
    """How each key position is grouped and compared.

    ``exact`` means both sides can be grouped in the very type the comparison
    uses, so one shuffle per side serves the grouping and the join.
    """

    left_kinds: tuple[str, ...]
    right_kinds: tuple[str, ...]
    types: tuple
    left_types: tuple
    right_types: tuple

    @property
    def comparable(self) -> bool:
        return self.left_kinds == self.right_kinds

    @property
    def exact(self) -> bool:
        return self.comparable and all(
            target is not None and kinds.widens(a, target) and kinds.widens(b, target)
            for target, a, b in zip(self.types, self.left_types, self.right_types)
        )


def key_plan(left: DataFrame, right: DataFrame, keys: KeySpec) -> KeyPlan:
    require_columns(left, keys.left, "left")
    require_columns(right, keys.right, "right")
    ltypes = tuple(left.schema[name].dataType for name in keys.left)
    rtypes = tuple(right.schema[name].dataType for name in keys.right)
    return KeyPlan(
        tuple(map(kinds.key_kind, ltypes)),
        tuple(map(kinds.key_kind, rtypes)),
        tuple(kinds.common_key_type(a, b) for a, b in zip(ltypes, rtypes)),
        ltypes,
        rtypes,
    )


def compared(columns, types, plan: KeyPlan) -> list[Column]:
    """Key columns as the comparison reads them: one type, or text when kinds differ."""
    if not plan.comparable:
        return [kinds.as_text(c, t) for c, t in zip(columns, types)]
    return [
        c if target is None or target == t else c.cast(target)
        for c, t, target in zip(columns, types, plan.types)
    ]


def all_present(columns) -> Column:
    return reduce(and_, [c.isNotNull() for c in columns])


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def multiplicities(df: DataFrame, names, types, plan: KeyPlan) -> DataFrame:
    """One row per distinct key: ``k0.. , n``; every null key shares the all-null row.

    Grouped in the comparison type where that is lossless, else in the column's
    own type.
    """
    columns = [named(df, name) for name in names]
    if plan.exact:
        columns = compared(columns, types, plan)
    if len(columns) > 1:
        present = all_present(columns)
        columns = [F.when(present, c) for c in columns]
    keyed = df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def comparison_counts(side: DataFrame, types, plan: KeyPlan) -> DataFrame:
    """The multiplicities regrouped in the type the comparison uses, nulls left out."""
    names = [c for c in side.columns if c != "n"]
    if plan.exact:
        return side.where(all_present([F.col(c) for c in names]))
    exprs = compared([F.col(c) for c in names], types, plan)
    keyed = side.select(*[e.alias(c) for e, c in zip(exprs, names)], "n")
    return (
        keyed.where(all_present([F.col(c) for c in names]))
        .groupBy(*names)
        .agg(F.sum("n").alias("n"))
    )


def prefixed(counts: DataFrame, side: str) -> DataFrame:
    """``k0, n`` renamed to ``lk0, ln`` or ``rk0, rn``."""
    return counts.select(*[F.col(c).alias(side + c) for c in counts.columns])


def match_condition(n_keys: int, left: str = "lk", right: str = "rk") -> Column:
    return reduce(and_, [F.col(f"{left}{i}") == F.col(f"{right}{i}") for i in range(n_keys)])
