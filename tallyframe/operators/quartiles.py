"""Exact quartiles of columns too large for one task to hold.

Order statistics are found by narrowing. Each pass proposes split points around
every wanted rank, and then counts exactly, over all rows, how many lie below each.
The proposals are quantiles of some of the rows still in question, so that the
partial sketches of many partitions stay small; they decide only where to look. A
split point either is the wanted value or excludes one side of itself, so a poor
proposal costs another pass, never a wrong answer. Once few enough rows are left
in question their values are counted and the rank is read off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

PROBABILITIES = (0.25, 0.5, 0.75)

# Sketch precision: a proposed bound lies within rows / SKETCH of its rank.
SKETCH = 10_000
MAX_PASSES = 200
# Rows, about, that propose the split points of one interval.
PROPOSING_ROWS = 1_000_000


@dataclass
class _Search:
    """One wanted rank (0-based, nulls excluded) of one column."""

    column: int
    rank: int
    inside: int  # rows still in question
    low: float | None = None  # both bounds exclusive, None while open
    high: float | None = None
    below: int = 0  # rows at or under `low`
    value: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    @property
    def offset(self) -> int:
        return self.rank - self.below


def wanted_ranks(n: int) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, weight of the upper) per quartile, by linear interpolation."""
    out = []
    for p in PROBABILITIES:
        position = (n - 1) * p
        low = math.floor(position)
        out.append((low, math.ceil(position), position - low))
    return out


def between(low: float, high: float, weight: float) -> float:
    return low if low == high else low + (high - low) * weight


def distributed_quartiles(
    table: DataFrame, non_null: dict[int, int], *, limit: int
) -> dict[int, list[float]]:
    """Column position to its three quartiles; ``non_null`` gives the rows per column."""
    if not non_null:
        return {}
    searches: dict[tuple[int, int], _Search] = {}
    for i, n in non_null.items():
        for low, high, _ in wanted_ranks(n):
            for rank in (low, high):
                searches.setdefault((i, rank), _Search(i, rank, inside=n))
    for attempt in range(MAX_PASSES):
        wide = [s for s in searches.values() if s.value is None and s.inside > limit]
        if not wide:
            break
        _narrow(table, wide, attempt)
    else:
        raise RuntimeError(f"quartiles are not pinned down after {MAX_PASSES} passes")
    _read_off(table, [s for s in searches.values() if s.value is None])
    return {
        i: [
            between(searches[i, low].value, searches[i, high].value, weight)
            for low, high, weight in wanted_ranks(n)
        ]
        for i, n in non_null.items()
    }


def _column(i: int) -> Column:
    return F.col(f"c{i}").cast("double")


def _inside(interval: tuple) -> Column:
    column, low, high = interval
    c = _column(column)
    condition = c.isNotNull()
    if low is not None:
        condition = condition & (c > low)
    if high is not None:
        condition = condition & (c < high)
    return condition


def _narrow(table: DataFrame, searches: list[_Search], seed: int) -> None:
    """Tighten every interval: one pass for split points, one for exact counts."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault(s.interval, []).append(s)
    intervals = list(groups)
    sketches = []
    for j, interval in enumerate(intervals):
        around = set()
        share = PROPOSING_ROWS / groups[interval][0].inside
        for s in groups[interval]:
            p = (s.offset + 0.5) / s.inside
            # four standard errors of a drawn quantile, plus the sketch's own error
            drawn = 4 * math.sqrt(p * (1 - p) / PROPOSING_ROWS) if share < 1 else 0.0
            margin = 2 / SKETCH + drawn
            around |= {max(0.0, round(p - margin, 6)), min(1.0, round(p + margin, 6))}
        proposes = _inside(interval)
        if share < 1:
            proposes = proposes & (F.col("draw") < share)
        rows = F.when(proposes, _column(interval[0]))
        sketches.append(F.percentile_approx(rows, sorted(around), SKETCH).alias(f"b{j}"))
    drawn = _rows_of(table, intervals).withColumn("draw", F.rand(seed))
    proposed = drawn.agg(*sketches).first()
    counts, splits = [], []
    for j, interval in enumerate(intervals):
        c, inside = _column(interval[0]), _inside(interval)
        splits.append(sorted(set(proposed[f"b{j}"] or [])))
        for m, split in enumerate(splits[j]):
            counts.append(F.count(F.when(inside & (c < split), 1)).alias(f"lt{j}_{m}"))
            counts.append(F.count(F.when(inside & (c <= split), 1)).alias(f"le{j}_{m}"))
    if not counts:  # no row happened to propose; the next pass draws others
        return
    counted = _rows_of(table, intervals).agg(*counts).first()
    for j, interval in enumerate(intervals):
        for s in groups[interval]:
            _place(s, [(v, counted[f"lt{j}_{m}"], counted[f"le{j}_{m}"])
                       for m, v in enumerate(splits[j])])


def _place(s: _Search, splits: list[tuple[float, int, int]]) -> None:
    """Move one search between the split points that enclose its rank."""
    offset, base, top = s.offset, s.below, s.inside
    under = 0
    for value, less, upto in splits:
        if less <= offset < upto:
            s.value = value
            return
        if offset < less:
            s.high, top = value, less
            break
        s.low, under = value, upto
    s.below, s.inside = base + under, top - under


def _rows_of(table: DataFrame, intervals: list[tuple]) -> DataFrame:
    """Rows any interval asks about, so the filter can reach the scan."""
    condition = _inside(intervals[0])
    for interval in intervals[1:]:
        condition = condition | _inside(interval)
    return table.where(condition)


def _read_off(table: DataFrame, searches: list[_Search]) -> None:
    """Read the wanted ranks from exact value counts of the small intervals left."""
    if not searches:
        return
    intervals = sorted({s.interval for s in searches}, key=str)
    tagged = [
        F.when(_inside(interval), F.struct(F.lit(j).alias("j"), _column(interval[0]).alias("v")))
        for j, interval in enumerate(intervals)
    ]
    hits = _rows_of(table, intervals).select(
        F.explode(F.array_compact(F.array(*tagged))).alias("hit")
    )
    counted = hits.select("hit.*").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    # at most `limit` rows per interval reach this window, by the counts above
    upto = Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    seen, n = F.col("seen"), F.col("n")
    wanted = F.lit(False)
    for s in searches:
        j = intervals.index(s.interval)
        wanted = wanted | ((F.col("j") == j) & (seen > s.offset) & (seen - n <= s.offset))
    rows = counted.withColumn("seen", F.sum("n").over(upto)).where(wanted).collect()
    for s in searches:  # at most one row per search came back
        j = intervals.index(s.interval)
        s.value = next(
            r["v"] for r in rows if r["j"] == j and r["seen"] - r["n"] <= s.offset < r["seen"]
        )
