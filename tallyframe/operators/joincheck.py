"""Diagnose a join from its keys alone: nothing is joined row by row.

The report needs one scan and one shuffle per side. Both multiplicity tables are
already partitioned by key, so the full outer join that compares them adds no
shuffle of its own.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.evidence import plain
from tallyframe.operators import keys as K
from tallyframe.session import hold, small_frame

EXAMPLE_KEYS = 5
EXAMPLE_ROWS = 3
LOW_COVERAGE = 0.5
HOWS = ("inner", "left", "right", "outer")

# A key set is sent to every executor only below this many bytes, measured.
BROADCAST_BYTES = 32 * 1024 * 1024

_WIDE = "decimal(38,0)"


class JoinCheck:
    """One pair of tables and keys, and every measurement taken of them."""

    def __init__(self, left: DataFrame, right: DataFrame, on=None, *, left_on=None, right_on=None):
        self.left, self.right = left, right
        self.keys = K.resolve_keys(on, left_on, right_on)
        self.plan = K.key_plan(left, right, self.keys)
        self.n_keys = len(self.keys.left)
        self._measured = None
        self._held: dict[str, DataFrame] = {}

    # --- multiplicities ---------------------------------------------------

    def side(self, which: str) -> DataFrame:
        """Key multiplicities of one side, the all-null row included."""
        if which in self._held:
            return self._held[which]
        if which == "left":
            return K.multiplicities(self.left, self.keys.left, self.plan.left_types, self.plan)
        return K.multiplicities(self.right, self.keys.right, self.plan.right_types, self.plan)

    @contextmanager
    def holding(self):
        """Keep both sides' multiplicities while several measurements read them."""
        self._held = {which: hold(self.side(which)) for which in ("left", "right")}
        try:
            yield self
        finally:
            for frame in self._held.values():
                frame.unpersist()
            self._held = {}

    def counts(self, which: str) -> DataFrame:
        types = self.plan.left_types if which == "left" else self.plan.right_types
        return K.comparison_counts(self.side(which), types, self.plan)

    def aligned(self) -> DataFrame:
        """Full outer join of the two multiplicity tables: ``lk*, ln, rk*, rn``."""
        fetch = self.side if self.plan.exact else self.counts
        left, right = K.prefixed(fetch("left"), "l"), K.prefixed(fetch("right"), "r")
        return left.join(right, K.match_condition(self.n_keys), "full")

    # --- the measurement --------------------------------------------------

    def measures(self) -> DataFrame:
        """Every count the report is made of, as one row."""
        if self.plan.exact:
            return self.aligned().agg(
                *map(F.expr, _side_counts("l") + _side_counts("r") + _overlap_counts(self.n_keys))
            )
        # Own-type and compared-type groups differ, so each side is counted apart.
        parts = [
            K.prefixed(self.side("left"), "l").agg(*map(F.expr, _side_counts("l"))),
            K.prefixed(self.side("right"), "r").agg(*map(F.expr, _side_counts("r"))),
            self.aligned().agg(*map(F.expr, _overlap_counts(self.n_keys))),
        ]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])

    def measured(self) -> dict:
        """The measures, taken once: one row of numbers on the driver."""
        if self._measured is None:
            self._measured = self.measures().first().asDict()
        return self._measured

    def report(self) -> DataFrame:
        """The whole report as one row of structs."""
        return report_columns(self.measures(), self.keys, self.plan)

    def report_of_measured(self) -> dict:
        """The report from counts already taken; costs no further scan."""
        spark = self.left.sparkSession
        row = self.measured()
        frame = small_frame(spark, [tuple(row.values())], measure_schema(list(row)))
        return plain(report_columns(frame, self.keys, self.plan).first())

    def conservation(self) -> DataFrame:
        """Result and dropped rows for the four join types, one row each."""
        return conservation_rows(self.measures())

    # --- evidence ---------------------------------------------------------

    def _facing(self, which: str):
        left = which == "left"
        own = (self.left, self.keys.left, self.plan.left_types)
        other = (self.right, self.keys.right, self.plan.right_types)
        return (own, "right") if left else (other, "left")

    def unmatched_keys_all(self, which: str) -> DataFrame:
        """Distinct non-null keys of one side that the other side lacks."""
        (_, names, types), facing = self._facing(which)
        own = K.prefixed(self.side(which), "l")
        lk = [F.col(f"lk{i}") for i in range(self.n_keys)]
        own = own.where(K.all_present(lk))
        other = K.prefixed(self.counts(facing), "r")
        exprs = lk if self.plan.exact else K.compared(lk, types, self.plan)
        condition = reduce(
            lambda a, b: a & b, [e == F.col(f"rk{i}") for i, e in enumerate(exprs)]
        )
        absent = own.join(other, condition, "left_anti")
        return absent.select(
            *[c.alias(name) for c, name in zip(lk, names)], F.col("ln").alias("n_rows")
        )

    def unmatched_keys(self, which: str) -> DataFrame:
        """The smallest few keys that match nothing, in the column's own type."""
        (df, names, types), _ = self._facing(which)
        absent = self.unmatched_keys_all(which)
        own = [K.named(absent, n).cast(t).alias(n) for n, t in zip(names, types)]
        return (
            absent.select(*own)
            .orderBy(*[F.col(f"`{n}`").asc_nulls_last() for n in names])
            .limit(EXAMPLE_KEYS)
        )

    def unmatched_rows_all(self, which: str) -> DataFrame:
        """Whole rows with a non-null key that matches nothing.

        When the measured set of unmatched keys is small it is broadcast and the
        wide table is filtered where it lies; otherwise the table is shuffled on
        its key against the other side's distinct keys, which adaptive execution
        may split where a key is hot.
        """
        (df, names, types), facing = self._facing(which)
        own = [K.named(df, n) for n in names]
        exprs = K.compared(own, types, self.plan)
        present = K.all_present(own)
        size = self._measured and _key_set_bytes(self._measured, which[0], self.n_keys)
        if size is not None and self._measured is not None and size <= BROADCAST_BYTES:
            absent = self.unmatched_keys_all(which)
            probe = absent.select(*[K.named(absent, n).alias(f"rk{i}") for i, n in enumerate(names)])
            condition = reduce(
                lambda a, b: a & b, [c == F.col(f"rk{i}") for i, c in enumerate(own)]
            )
            return df.where(present).join(F.broadcast(probe), condition, "left_semi")
        other = K.prefixed(self.counts(facing), "r").drop("rn")
        condition = reduce(
            lambda a, b: a & b, [e == F.col(f"rk{i}") for i, e in enumerate(exprs)]
        )
        return df.where(present).join(other, condition, "left_anti")

    def unmatched_rows(self, which: str) -> DataFrame:
        return first_rows(self.unmatched_rows_all(which), EXAMPLE_ROWS)

    def null_key_rows(self, which: str) -> DataFrame:
        """The first few rows, in the order of all columns, with any key null."""
        (df, names, _), _ = self._facing(which)
        missing = reduce(or_, [K.named(df, n).isNull() for n in names])
        return first_rows(df.where(missing), EXAMPLE_ROWS)

    def fan_out_examples(self) -> DataFrame:
        """Shared keys that repeat on either side, the largest products first."""
        pairs = K.prefixed(self.counts("left"), "l").join(
            K.prefixed(self.counts("right"), "r"), K.match_condition(self.n_keys), "inner"
        )
        key = [F.col(f"lk{i}") for i in range(self.n_keys)]
        return (
            pairs.where((F.col("ln") > 1) | (F.col("rn") > 1))
            .orderBy(F.expr(_PRODUCT).desc(), *[c.asc_nulls_last() for c in key])
            .limit(EXAMPLE_KEYS)
            .select(
                *[c.alias(n) for c, n in zip(key, self.keys.left)],
                F.col("ln").alias("n_left"),
                F.col("rn").alias("n_right"),
            )
        )

    def evidence(self) -> DataFrame:
        """The findings' example rows as one frame: ``evidence, place, row, n_left, n_right``.

        ``row`` is the example as JSON, a key for fan-out. Each side's rows are read once:
        a row is marked by whether its key is null or met, and of every kind each task
        keeps but the few smallest rows before any are sent.
        """
        parts = [self._marked_rows(which) for which in ("left", "right")]
        key = F.to_json(F.struct(*[F.col(f"`{n}`") for n in self.keys.left]), {"ignoreNullFields": "false"})
        hot = self.fan_out_examples()
        order = Window.orderBy(F.expr(_PRODUCT.replace("ln", "n_left").replace("rn", "n_right")).desc(),
                               *[F.col(f"`{n}`").asc_nulls_last() for n in self.keys.left])
        parts.append(hot.select(F.lit("fan_out_examples").alias("evidence"), F.row_number().over(order).alias("place"),
                                key.alias("row"), "n_left", "n_right"))  # of a handful of rows
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _marked_rows(self, which: str) -> DataFrame:
        (df, names, types), facing = self._facing(which)
        own = [K.named(df, n) for n in names]
        other = K.prefixed(self.counts(facing), "r").drop("rn").withColumn("met", F.lit(True))
        match = reduce(lambda a, b: a & b, [
            e == F.col(f"rk{i}") for i, e in enumerate(K.compared(own, types, self.plan))])
        columns = [f"c{i}" for i in range(len(df.columns))]
        marked = df.join(other, match, "left").select(
            F.when(~K.all_present(own), f"null_key_{which}_rows").when(F.col("met").isNull(), f"unmatched_{which}_rows").alias("evidence"),
            *[K.named(df, n).alias(c) for n, c in zip(df.columns, columns)])
        ordered = [F.to_json(c) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(c)
                   for c, f in zip(columns, df.schema.fields)]
        place = F.row_number().over(Window.partitionBy("evidence").orderBy(*[c.asc_nulls_last() for c in ordered]))
        few = marked.where("evidence IS NOT NULL").withColumn("place", place).where(F.col("place") <= EXAMPLE_ROWS)
        row = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in zip(df.columns, columns)]), {"ignoreNullFields": "false"})
        return few.select("evidence", "place", row.alias("row"))

    # --- edge -------------------------------------------------------------

    def report_dict(self) -> dict:
        """The report with its example keys, as plain values."""
        report = self.report_of_measured()
        for which in ("left", "right"):
            some = self.measured()[f"n_{which}_only_keys"]
            rows = self.unmatched_keys(which).collect() if some else []
            report["overlap"][f"sample_{which}_only"] = [_key_value(r) for r in rows]
        return report

    def findings(self) -> dict:
        """The report plus a handful of example rows per anomaly.

        The counts say which anomalies there are; nothing is searched for the others.
        """
        with self.holding():
            m = self.measured()
            rows = lambda some, frame: [plain(r) for r in frame().collect()] if some else []
            fan_out = max(m["max_left_to_right"], m["max_right_to_left"]) > 1
            return {
                "report": self.report_dict(),
                "evidence": {
                    "unmatched_left_rows": rows(
                        m["n_left_only_keys"], lambda: self.unmatched_rows("left")),
                    "unmatched_right_rows": rows(
                        m["n_right_only_keys"], lambda: self.unmatched_rows("right")),
                    "null_key_left_rows": rows(
                        m["l_null_rows"], lambda: self.null_key_rows("left")),
                    "null_key_right_rows": rows(
                        m["r_null_rows"], lambda: self.null_key_rows("right")),
                    "fan_out_examples": [
                        {"key": _key_value(list(r)[:-2]), "n_left": r["n_left"], "n_right": r["n_right"]}
                        for r in (self.fan_out_examples().collect() if fan_out else [])
                    ],
                },
            }


def _key_value(values):
    values = plain(list(values))
    return values[0] if len(values) == 1 else values


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of all columns; each task keeps only n."""
    order = []
    for field in df.schema.fields:
        column = K.named(df, field.name)
        if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString():
            column = F.to_json(column)
        order.append(column.asc_nulls_last())
    return df.orderBy(*order).limit(n)


# --- aggregates over the aligned multiplicities ------------------------------


# two bigints multiplied can pass 2^63, so the product is taken wide
_PRODUCT = "CAST(ln AS DECIMAL(19, 0)) * CAST(rn AS DECIMAL(19, 0))"


def _total(n: str, condition: str) -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN {n} END), CAST(0 AS BIGINT))"


def _side_counts(s: str) -> list[str]:
    n, present = f"{s}n", f"{s}k0 IS NOT NULL"
    return [
        f"{_total(n, 'true')} AS {s}_rows",
        f"{_total(n, f'{s}k0 IS NULL')} AS {s}_null_rows",
        f"count_if({present} AND {n} IS NOT NULL) AS {s}_distinct",
        f"count_if({present} AND {n} > 1) AS {s}_duplicated",
        f"coalesce(max(CASE WHEN {present} THEN {n} END), CAST(0 AS BIGINT)) AS {s}_max",
    ]


def _overlap_counts(n_keys: int) -> list[str]:
    shared = "ln IS NOT NULL AND rn IS NOT NULL"
    left_only, right_only = "lk0 IS NOT NULL AND rn IS NULL", "rk0 IS NOT NULL AND ln IS NULL"
    width = lambda s: " + ".join(f"octet_length(CAST({s}k{i} AS STRING))" for i in range(n_keys))
    largest = lambda n: f"coalesce(max(CASE WHEN {shared} THEN {n} END), CAST(0 AS BIGINT))"
    return [
        f"CAST(coalesce(sum(CASE WHEN {shared} THEN {_PRODUCT} END), 0) AS {_WIDE}) AS inner_rows",
        f"{_total('ln', shared)} AS matched_left",
        f"{_total('rn', shared)} AS matched_right",
        f"count_if({shared}) AS n_shared_keys",
        f"count_if({left_only}) AS n_left_only_keys",
        f"count_if({right_only}) AS n_right_only_keys",
        f"{_total('ln', left_only)} AS left_only_rows",
        f"{_total('rn', right_only)} AS right_only_rows",
        f"{largest('rn')} AS max_left_to_right",
        f"{largest('ln')} AS max_right_to_left",
        f"{_total(f'CAST({width('l')} AS BIGINT)', left_only)} AS left_only_key_bytes",
        f"{_total(f'CAST({width('r')} AS BIGINT)', right_only)} AS right_only_key_bytes",
    ]


def measure_schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_WIDE if n == 'inner_rows' else 'bigint'}" for n in names)


def _key_set_bytes(measured: dict, side: str, n_keys: int) -> int:
    word = "left" if side == "l" else "right"
    return measured[f"{word}_only_key_bytes"] + 32 * n_keys * measured[f"n_{word}_only_keys"]


# --- columns derived from the counts -----------------------------------------


def with_derived(m: DataFrame) -> DataFrame:
    """Coverage, relationship and row conservation, added to the counts."""
    share = lambda part, whole: (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) ELSE 0D END"
    )
    left_dropped, right_dropped = "l_null_rows + left_only_rows", "r_null_rows + right_only_rows"
    return m.selectExpr(
        "*",
        "l_max <= 1 AS l_unique",
        "r_max <= 1 AS r_unique",
        "CASE WHEN l_max <= 1 AND r_max <= 1 THEN '1:1' WHEN l_max <= 1 THEN '1:many' "
        "WHEN r_max <= 1 THEN 'many:1' ELSE 'many:many' END AS relationship",
        f"{left_dropped} AS left_dropped",
        f"{right_dropped} AS right_dropped",
        f"{share('matched_left', 'l_rows')} AS left_coverage",
        f"{share('matched_right', 'r_rows')} AS right_coverage",
        f"{share('inner_rows', 'matched_left')} AS result_per_matched_left",
        "inner_rows AS rows_inner",
        f"CAST(inner_rows + {left_dropped} AS {_WIDE}) AS rows_left",
        f"CAST(inner_rows + {right_dropped} AS {_WIDE}) AS rows_right",
        f"CAST(inner_rows + {left_dropped} + {right_dropped} AS {_WIDE}) AS rows_outer",
    )


def join_flags(comparable: bool) -> str:
    """What is notable about the join, in a fixed order."""
    conditions = {
        "key_dtype_mismatch": str(not comparable).lower(),
        "no_matches": "inner_rows = 0",
        "many_to_many": "relationship = 'many:many'",
        "left_rows_dropped": "left_dropped > 0",
        "fan_out": "greatest(max_left_to_right, max_right_to_left) > 1",
        "null_keys": "l_null_rows + r_null_rows > 0",
        "low_overlap": f"left_coverage < {LOW_COVERAGE}",
        "right_rows_dropped": "right_dropped > 0",
    }
    marks = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in conditions.items())
    return f"array_compact(array({marks}))"


def _side_struct(s: str) -> str:
    return (
        f"named_struct('n_rows', {s}_rows, 'n_null_keys', {s}_null_rows, "
        f"'n_distinct_keys', {s}_distinct, 'n_duplicated_keys', {s}_duplicated, "
        f"'max_key_multiplicity', {s}_max, 'unique_keys', {s}_unique)"
    )


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Which sides lose rows under each join type.
_LOSES = {"inner": ("left", "right"), "left": ("right",), "right": ("left",), "outer": ()}


def _join_struct(how: str, named: str = "") -> str:
    dropped = lambda s: f"{s}_dropped" if s in _LOSES[how] else "CAST(0 AS BIGINT)"
    return (
        f"named_struct({named}'result_rows', rows_{how}, 'left_dropped', {dropped('left')}, "
        f"'right_dropped', {dropped('right')})"
    )


def report_columns(m: DataFrame, keys: K.KeySpec, plan: K.KeyPlan) -> DataFrame:
    joins = ", ".join(f"'{how}', {_join_struct(how)}" for how in HOWS)
    shown = with_derived(m).selectExpr(
        f"{_side_struct('l')} AS left",
        f"{_side_struct('r')} AS right",
        f"{str(plan.comparable).lower()} AS key_dtype_match",
        "relationship",
        "struct(n_shared_keys, n_left_only_keys, n_right_only_keys, left_coverage, right_coverage) AS overlap",
        "struct(max_left_to_right, max_right_to_left, result_per_matched_left) AS fan_out",
        f"named_struct({joins}) AS joins",
        f"{join_flags(plan.comparable)} AS flags",
    )
    pair = lambda a, b: F.struct(_texts(a).alias("left"), _texts(b).alias("right"))
    return shown.select(
        pair(keys.left, keys.right).alias("keys"),
        "left",
        "right",
        pair(plan.left_kinds, plan.right_kinds).alias("key_dtypes"),
        "key_dtype_match",
        "relationship",
        "overlap",
        "fan_out",
        "joins",
        "flags",
    )


def conservation_rows(m: DataFrame) -> DataFrame:
    """``how, result_rows, left_dropped, right_dropped``: four rows."""
    rows = ", ".join(_join_struct(how, f"'how', '{how}', ") for how in HOWS)
    return with_derived(m).selectExpr(f"inline(array({rows}))")


def join_report(left, right, on=None, *, left_on=None, right_on=None) -> DataFrame:
    return JoinCheck(left, right, on, left_on=left_on, right_on=right_on).report()


def join_findings(left, right, on=None, *, left_on=None, right_on=None) -> dict:
    return JoinCheck(left, right, on, left_on=left_on, right_on=right_on).findings()
