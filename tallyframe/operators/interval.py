"""Interval and band joins, counted before they are built.

A left row has a point, a right row an interval; they meet where their keys are equal and
the interval holds the point. Both ends of every interval and all points give a histogram,
whose quantiles cut the line into cells of equal weight. The cells are the leaves of a
dyadic tree: an interval is stored once on each of the few largest tree nodes that make it
up, however long it is, and a point looks along its path to the root, at the nodes that
hold anything. So the join is one on equal (key, node), which adaptive execution may
split, and each pair meets at exactly one node.

The size of the result needs no join: of the intervals that begin at or before a point,
those that ended before it are taken away. Both are running sums along the key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import kinds
from tallyframe.operators import keys as K
from tallyframe.operators.joining import OutputColumn, output_columns
from tallyframe.operators.ordered import running_sums
from tallyframe.session import pin

LEVELS = 10  # 1,024 cells; 2,047 nodes
HOWS = ("inner", "left")
TASK_PAIRS = 20_000_000  # pairs that a task looks at
MOST_SPLITS = 1_000  # shares that one node is split into at the most
_WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Bounds:
    """The interval of a right row, and whether its ends belong to it."""

    low: Column
    high: Column
    low_in: bool = True
    high_in: bool = True

    def holds(self, at: Column, low: Column, high: Column) -> Column:
        above = at >= low if self.low_in else at > low
        return above & (at <= high if self.high_in else at < high)


class IntervalJoin:
    """One pair of tables, the points of the left and the intervals of the right.

    ``on`` or ``left_on`` and ``right_on`` name keys that must be equal besides; without
    them any row may meet any. A null (or NaN) key, point or end, and an interval whose
    end lies before its beginning, meets nothing.
    """

    def __init__(self, left: DataFrame, right: DataFrame, point: Column, bounds: Bounds, *,
                 on=None, left_on=None, right_on=None):
        self.left, self.right, self.bounds = left, right, bounds
        keyed = on is not None or left_on is not None or right_on is not None
        self.spec = K.resolve_keys(on, left_on, right_on) if keyed else K.KeySpec((), (), False)
        self.plan = K.key_plan(left, right, self.spec)
        self.columns = output_columns(left.columns, right.columns, self.spec)
        self.keys = [f"k{i}" for i in range(len(self.spec.left))]
        self.points = self._side(left, "l", self.spec.left, self.plan.left_types, {"x": point})
        self.spans = self._side(right, "r", self.spec.right, self.plan.right_types, {"lo": bounds.low, "hi": bounds.high})
        types = [self.points.schema["x"].dataType, self.spans.schema["lo"].dataType, self.spans.schema["hi"].dataType]
        found = {kinds.key_kind(t) for t in types}
        if found not in ({kinds.NUMERIC}, {kinds.DATETIME}):
            raise ValueError("points and ends of intervals must all be numbers, or all dates and timestamps")
        (self.kind,) = found
        # one type for points and ends
        self.line = types[0].simpleString()
        if len(set(types)) > 1:
            self.line = "timestamp" if self.kind == kinds.DATETIME else reduce(kinds.common_key_type, types).simpleString()

    def _side(self, df: DataFrame, s: str, names, types, more: dict[str, Column]) -> DataFrame:
        read = K.compared([K.named(df, c) for c in names], types, self.plan)
        return df.select(*[e.alias(k) for e, k in zip(read, self.keys)], *[c.alias(n) for n, c in more.items()],
                         *[K.named(df, c).alias(f"{s}{i}") for i, c in enumerate(df.columns)])

    def _usable(self, df: DataFrame, *names: str) -> Column:
        fine = K.all_present([F.col(c) for c in [*self.keys, *names]])
        for name in names:
            if df.schema[name].dataType.typeName() in ("float", "double"):
                fine = fine & ~F.isnan(name)
        if "lo" in names:
            empty = F.col("lo") > F.col("hi") if self.bounds.low_in and self.bounds.high_in else F.col("lo") >= F.col("hi")
            fine = fine & ~empty
        return F.coalesce(fine, F.lit(False))

    # --- counting ------------------------------------------------------------

    def report(self) -> DataFrame:
        """One row: rows of both sides, result rows, rows met and not, and the most that one row meets."""
        points = self.points.where(self._usable(self.points, "x")).groupBy(*self.keys, "x").agg(F.count("*").alias("p"))
        spans = pin(self.spans.where(self._usable(self.spans, "lo", "hi")).groupBy(*self.keys, "lo", "hi").agg(F.count("*").alias("n")))
        points = pin(points)
        # what counts as begun at a point, and what as ended before it, at each value: ends that
        # belong to the interval begin before and end after the points there
        zero = F.lit(0).cast("bigint")

        def stream(df, value, turn, **counts):
            return df.select(*self.keys, F.col(value).cast(self.line).alias("v"), F.lit(turn).alias("turn"),
                             *[counts.get(c, zero).alias(c) for c in ("p", "s", "e")])

        begins, ends = 0 if self.bounds.low_in else 2, 2 if self.bounds.high_in else 0
        rows = (stream(points, "x", 1, p=F.col("p"))
                .unionByName(stream(spans, "lo", begins, s=F.col("n")))
                .unionByName(stream(spans, "hi", ends, e=F.col("n"))))
        grouped = rows.groupBy(*self.keys, "v", "turn").agg(*[F.sum(c).alias(c) for c in ("p", "s", "e")])
        run = pin(running_sums(grouped, self.keys, ["v", "turn"], {"points": "p", "begun": "s", "ended": "e"}))
        met = F.col("begun") - F.col("ended")
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        left = run.where("turn = 1").select("p", met.alias("n")).agg(
            F.coalesce(F.sum(wide("p") * wide("n")), F.lit(0)).cast(_WIDE).alias("result_rows"),
            F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("p"))), zero).alias("matched_left"),
            F.coalesce(F.max("n"), zero).alias("max_left_to_right"))
        # points up to an interval's end, less those before its beginning
        at = lambda turn, name: run.where(F.col("turn") == turn).select(
            *[F.col(k).alias(f"{name}_{k}") for k in self.keys], F.col("v").alias(f"{name}_v"), F.col("points").alias(name))
        found = spans
        for name, column, turn in (("before", "lo", begins), ("upto", "hi", ends)):
            table = at(turn, name)
            match = reduce(and_, [F.col(k) == F.col(f"{name}_{k}") for k in self.keys],
                           F.col(column).cast(self.line) == F.col(f"{name}_v"))
            found = found.join(table, match)
        inside = F.col("upto") - F.col("before")
        right = found.select("n", inside.alias("inside")).agg(
            F.coalesce(F.sum(F.when(F.col("inside") > 0, F.col("n"))), zero).alias("matched_right"),
            F.coalesce(F.max("inside"), zero).alias("max_right_to_left"))
        rows_of = lambda df, name: df.agg(F.count("*").alias(name))
        parts = [rows_of(self.left, "left_rows"), rows_of(self.right, "right_rows"), left, right]  # a row each
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        whole = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
        return whole.select(
            "left_rows", "right_rows", "result_rows", "matched_left", (F.col("left_rows") - F.col("matched_left")).alias("unmatched_left"),
            "matched_right", (F.col("right_rows") - F.col("matched_right")).alias("unmatched_right"),
            "max_left_to_right", "max_right_to_left")

    # --- building ------------------------------------------------------------

    def join(self, how: str = "inner") -> DataFrame:
        """The rows that meet; with ``left`` also the left rows that meet none."""
        if how not in HOWS:
            raise ValueError(f"how must be one of {list(HOWS)}")
        points = self.points
        if how == "left":  # rows are told apart by their place in one written table
            points = pin(points.withColumn("row", F.monotonically_increasing_id()))
        usable, spans = points.where(self._usable(points, "x")), self.spans.where(self._usable(self.spans, "lo", "hi"))
        cuts = self._cuts(usable, spans)
        stored = pin(spans.withColumn("node", F.explode(_cover(_cell(F.col("lo"), self.kind, cuts), _cell(F.col("hi"), self.kind, cuts)))))
        held = {r.node for r in stored.select("node").distinct().collect()}  # of 2,047 at the most
        there = F.lit([n in held for n in range(2 << LEVELS)])
        path = F.array(*[F.shiftright("leaf", up) for up in range(LEVELS + 1)])
        asking = usable.withColumn("leaf", _cell(F.col("x"), self.kind, cuts) + (1 << LEVELS)).withColumn(
            "node", F.explode(F.filter(path, lambda n: there[n])))
        asking, stored, at = self._dealt(asking, stored)
        match = reduce(and_, [asking[c] == stored[c] for c in at]) & self.bounds.holds(F.col("x"), F.col("lo"), F.col("hi"))
        shown = [_read(c, self.left.columns, self.right.columns) for c in self.columns]
        met = asking.join(stored, match).select(*shown)
        if how == "inner":
            return met
        # the pairs go straight to the result; only which rows met any is looked up once more
        hit = pin(asking.join(stored, match, "left_semi").select("row").distinct())
        nothing = [F.lit(None).cast(f.dataType).alias(f"r{i}") for i, f in enumerate(self.right.schema.fields)]
        return met.unionByName(points.join(hit, "row", "left_anti").select("*", *nothing).select(*shown))

    def _dealt(self, asking: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides in as many tasks as their pairs need, and the columns on which they meet.

        Where one node has more pairs than a task should, the side with more rows there is cut
        into shares, and each meets all rows of the other side.
        """
        at = [*self.keys, "node"]
        both = asking.groupBy(*at).agg(F.count("*").alias("a")).join(stored.groupBy(*at).agg(F.count("*").alias("b")), at)
        loads = pin(both.withColumn("pairs", F.col("a").cast("double") * F.col("b")))
        total, most = loads.agg(F.sum("pairs"), F.max("pairs")).first()
        tasks = math.ceil((total or 0) / TASK_PAIRS)
        if tasks <= 1:
            return asking, stored, at
        if most <= TASK_PAIRS:
            return asking.repartition(tasks, *at), stored.repartition(tasks, *at), at
        # no more nodes than tasks
        large = loads.where(F.col("pairs") > TASK_PAIRS).select(
            *at, F.least(F.ceil(F.col("pairs") / TASK_PAIRS), F.lit(MOST_SPLITS)).cast("int").alias("shares"),
            (F.col("a") >= F.col("b")).alias("cut"))

        def cut(df, own):
            """A row of the side that is cut goes to one share, any other to all."""
            place = F.pmod(F.col("place"), F.col("shares")).cast("int")
            share = F.when(F.col("shares").isNull(), F.array(F.lit(0))).when(own, F.array(place)).otherwise(
                F.sequence(F.lit(0), F.col("shares") - 1))
            placed = df.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(large), at, "left")
            return placed.withColumn("share", F.explode(share)).drop("place", "shares", "cut").repartition(tasks, *at, "share")

        return cut(asking, F.col("cut")), cut(stored, ~F.col("cut")), [*at, "share"]

    def _cuts(self, points: DataFrame, spans: DataFrame) -> list[float]:
        """Quantiles of points and ends: 1,023 numbers, ascending, ready for a binary search."""
        number = lambda name: _number(F.col(name), self.kind)
        ends = spans.select(F.explode(F.array(number("lo"), number("hi"))).alias("v"))
        shares = [n / (1 << LEVELS) for n in range(1, 1 << LEVELS)]
        found = points.select(number("x").alias("v")).unionByName(ends).agg(
            F.percentile_approx("v", shares, 10 << LEVELS)).first()[0] or []
        cuts = sorted(set(found))
        return cuts + [math.inf] * (len(shares) - len(cuts))


def _number(column: Column, kind: str) -> Column:
    """A number in the order of the values; different values may share one."""
    if kind == kinds.DATETIME:
        column = F.unix_micros(column.cast("timestamp"))
    return column.cast("double")


def _cell(value: Column, kind: str, cuts: list[float]) -> Column:
    """How many cuts lie at or below the value, by binary search."""
    at = _number(value, kind)
    steps = F.lit([1 << n for n in range(LEVELS - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(
        F.lit(cuts)[found + step - 1] <= at, found + step).otherwise(found))


def _cover(first: Column, last: Column) -> Column:
    """The fewest tree nodes that hold the cells from first to last and no other; the root is 1."""
    start = F.struct((first + (1 << LEVELS)).cast("int").alias("a"), (last + (1 << LEVELS) + 1).cast("int").alias("b"),
                     F.array().cast("array<int>").alias("nodes"))

    none = F.array().cast("array<int>")

    def up(state, _):
        a, b = state["a"], state["b"]
        nodes = F.concat(state["nodes"], F.when((a < b) & (a % 2 == 1), F.array(a)).otherwise(none),
                         F.when((a < b) & (b % 2 == 1), F.array(b - 1)).otherwise(none))
        return F.struct(F.shiftright(a + 1, 1).alias("a"), F.shiftright(b, 1).alias("b"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, up, lambda s: s["nodes"])


def _read(column: OutputColumn, left: list[str], right: list[str]) -> Column:
    source = f"l{left.index(column.left)}" if column.left is not None else f"r{right.index(column.right)}"
    return F.col(source).alias(column.name)


def interval_join(left: DataFrame, right: DataFrame, *, point: str, low: str, high: str, closed: str = "both",
                  on=None, left_on=None, right_on=None) -> IntervalJoin:
    """Left rows whose ``point`` lies between ``low`` and ``high`` of a right row; ``closed`` is both, left, right or neither."""
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError("closed must be both, left, right or neither")
    bounds = Bounds(K.named(right, low), K.named(right, high), closed in ("both", "left"), closed in ("both", "right"))
    return IntervalJoin(left, right, K.named(left, point), bounds, on=on, left_on=left_on, right_on=right_on)


def band_join(left: DataFrame, right: DataFrame, *, left_value: str, right_value: str, below, above,
              on=None, left_on=None, right_on=None) -> IntervalJoin:
    """Left rows whose value lies from ``below`` less to ``above`` more than that of a right row.

    ``below`` and ``above`` are numbers, or interval columns for dates and timestamps.
    """
    value = K.named(right, right_value)
    return IntervalJoin(left, right, K.named(left, left_value), Bounds(value - below, value + above),
                        on=on, left_on=left_on, right_on=right_on)
