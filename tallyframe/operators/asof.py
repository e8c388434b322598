"""As-of join: each left row meets the right row of its key that is last at its time.

Both sides are put into one table, ordered by key and time over range-partitioned cells,
and read once: the last right row is carried along. A key of any number of rows lies over
many cells; the right row at a cell's end is handed to the rows of later cells that come
before any right row of their own. Nothing is joined pair by pair and no key is one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StructField, StructType

from tallyframe.operators import keys as K
from tallyframe.operators.joining import OutputColumn, output_columns
from tallyframe.operators.ordered import CELL, in_cells
from tallyframe.session import pin

# Tasks get this module's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOWS = ("left", "inner")
DIRECTIONS = ("backward", "forward")
DONE, OPEN, EDGE = 0, 1, 2  # a row's right row is settled; it may lie in an earlier cell; a cell's end


@dataclass
class AsOf:
    """An as-of join: its rows, its column mapping, and how many rows met one."""

    df: DataFrame
    columns: list[OutputColumn]
    matched: DataFrame  # one boolean a left row

    def report(self) -> DataFrame:
        """One row: left rows, those that met a right row, those that did not, and their share."""
        met = F.count_if("matched")
        return self.matched.agg(
            F.count("*").alias("left_rows"), met.alias("matched_left"),
            (F.count("*") - met).alias("unmatched_left"),
            F.when(F.count("*") == 0, 0.0).otherwise(met / F.count("*")).alias("left_coverage"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str,
    right_time: str,
    on=None,
    left_on=None,
    right_on=None,
    how: str = "left",
    direction: str = "backward",
    allow_equal: bool = True,
    within: Column | None = None,
) -> AsOf:
    """Join each left row to the nearest right row of its key in time.

    ``backward`` takes the last right row at or before the left row's time, ``forward``
    the first at or after it; without ``allow_equal`` strictly so. ``within`` is a
    condition over ``left_time`` and ``right_time`` that the met row must satisfy as well
    (``F.expr("left_time - right_time < INTERVAL 1 DAY")``). Right rows of one key and time
    are told apart by their columns in order, the greatest is met. A row whose key or time
    is null meets nothing; with ``how="left"`` it stays, its right columns null. Names and
    suffixes are those of other joins; both times stay.
    """
    if how not in HOWS or direction not in DIRECTIONS:
        raise ValueError(f"how must be one of {list(HOWS)}, direction one of {list(DIRECTIONS)}")
    spec = K.resolve_keys(on, left_on, right_on)
    plan = K.key_plan(left, right, spec)
    times = K.key_plan(left, right, K.resolve_keys(None, left_time, right_time))
    if not times.comparable or any(isinstance(t, (ArrayType, MapType, StructType)) for t in plan.left_types + plan.right_types):
        raise ValueError("an as-of join needs times of one kind, and keys that are not nested")
    columns = output_columns(left.columns, right.columns, spec)
    n, lefts, rights = len(spec.left), [f"l{i}" for i in range(len(left.columns))], [f"r{i}" for i in range(len(right.columns))]
    keys = [f"k{i}" for i in range(n)]

    def side(df: DataFrame, names: list[str], key_names, time: str, types, time_type) -> DataFrame:
        read = K.compared([K.named(df, c) for c in key_names], types, plan)
        (at,) = K.compared([K.named(df, time)], time_type, times)
        return df.select(*[e.alias(k) for e, k in zip(read, keys)], at.alias("t"),
                         *[K.named(df, c).alias(a) for c, a in zip(df.columns, names)])

    a = side(left, lefts, spec.left, left_time, plan.left_types, times.left_types)
    b = side(right, rights, spec.right, right_time, plan.right_types, times.right_types)
    present = K.all_present([F.col(c) for c in [*keys, "t"]])
    # equal times: whichever comes later in the pass sees the other
    both = a.where(present).withColumn("late", F.lit(allow_equal)).unionByName(
        b.where(present).withColumn("late", F.lit(not allow_equal)), allowMissingColumns=True).withColumn(
        "is_left", F.col("late") == F.lit(allow_equal))
    ordered = [c for c, f in zip(rights, right.schema.fields) if _plain(f.dataType)]
    spread = F.xxhash64(*[c for c, f in zip(lefts, left.schema.fields) if _plain(f.dataType)])
    # in a forward pass the first of equal rows comes last too: the greatest is met either way
    order = [F.asc(k) for k in keys] + [F.asc("t") if direction == "backward" else F.desc("t"), F.asc("late")]
    order += [F.asc(c) for c in ordered] + [F.when(F.col("is_left"), spread)]
    schema = StructType([StructField(f.name, f.dataType) for f in both.schema.fields if f.name not in ("late", "is_left")]
                        + [StructField(CELL, IntegerType()), StructField("hit", BooleanType()), StructField("kind", IntegerType())])
    told = pin(in_cells(both, order).drop("late").mapInArrow(_carry(keys, rights, schema.names), schema))

    edges = told.where((F.col("kind") == EDGE) & F.col("hit")).select(CELL, *keys, F.struct(*rights).alias("held"))
    asked = told.where(F.col("kind") == OPEN).select(CELL, *keys).distinct()
    before = Window.partitionBy(*keys).orderBy(CELL, F.col("held").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    # a row or two a cell: what the cells before hold for the first key of each
    handed = pin(edges.unionByName(asked, allowMissingColumns=True).withColumn(
        "carried", F.last("held", ignorenulls=True).over(before)).where("held IS NULL AND carried IS NOT NULL").select(
        F.col(CELL).alias("c"), "carried"))
    settled = told.where(F.col("kind") == DONE).select(*lefts, "hit", *rights)
    late = told.where(F.col("kind") == OPEN).select(CELL, *lefts).join(handed, F.col(CELL) == F.col("c"), "left").select(
        *lefts, F.col("carried").isNotNull().alias("hit"), *[F.col("carried")[r].alias(r) for r in rights])
    met = settled.unionByName(late)
    if within is not None:
        real = met.select("*", F.col(lefts[left.columns.index(left_time)]).alias("left_time"),
                          F.col(rights[right.columns.index(right_time)]).alias("right_time"))
        close = F.col("hit") & F.coalesce(within, F.lit(False))
        met = real.select(*lefts, close.alias("hit"), *[F.when(close, F.col(r)).alias(r) for r in rights])
    alone = a.where(~F.coalesce(present, F.lit(False))).select(
        *lefts, F.lit(False).alias("hit"), *[F.lit(None).cast(f.dataType).alias(r) for r, f in zip(rights, right.schema.fields)])
    rows = met.unionByName(alone)
    shown = rows.where("hit") if how == "inner" else rows
    return AsOf(shown.select(*[_read(c, left.columns, right.columns) for c in columns]), columns,
                rows.select(F.col("hit").alias("matched")))


def _read(column: OutputColumn, left: list[str], right: list[str]) -> Column:
    # a shared key reads the left side, which every row has
    source = f"l{left.index(column.left)}" if column.left is not None else f"r{right.index(column.right)}"
    return F.col(source).alias(column.name)


def _plain(dtype) -> bool:
    """Whether values of a type have an order and a hash."""
    return "map<" not in dtype.simpleString() and "variant" not in dtype.simpleString()


def _carry(keys: list[str], rights: list[str], shown: list[str]):
    """Reads a cell in order; yields its left rows with the last right row of their key, and the cell's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, first = None, True  # the row read last, holding the last right row of its key; no key but the cell's first so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            if tail is not None:
                table = pa.concat_tables([tail, table])
            rows = np.arange(table.num_rows)
            new = np.zeros(len(rows), bool)
            for key in keys:
                new[1:] |= _differ(table[key].combine_chunks())
            starts = np.maximum.accumulate(np.where(new, rows, 0))
            is_left = table["is_left"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            last = np.maximum.accumulate(np.where(is_left, -1, rows))
            hit = last >= starts
            held = table.select(rights).take(pa.array(last, mask=~hit))
            opening = first & (np.cumsum(new) == 0)
            wanted = is_left.copy()
            if tail is not None:
                wanted[0] = False
            out = table
            for name in rights:
                out = out.set_column(out.schema.get_field_index(name), name, held[name])
            kind = np.where(opening & ~hit, OPEN, DONE)
            yield from _marked(out, hit, kind).select(shown).filter(pa.array(wanted)).to_batches()
            first = first and not new.any()
            tail = out.slice(len(rows) - 1)
            tail = tail.set_column(tail.schema.get_field_index("is_left"), "is_left", pa.array([not hit[-1]]))
        if tail is not None:
            yield from _marked(tail, np.array([not tail["is_left"][0].as_py()]), np.array([EDGE])).select(shown).to_batches()

    return run


def _marked(table: pa.Table, hit: np.ndarray, kind: np.ndarray) -> pa.Table:
    return table.append_column("hit", pa.array(hit)).append_column("kind", pa.array(kind.astype(np.int32)))


def _differ(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it, from the second on; NaN equals NaN."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.not_equal(a, b)
    if pa.types.is_floating(column.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
    return differ.to_numpy(zero_copy_only=False)
