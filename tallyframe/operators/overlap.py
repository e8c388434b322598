"""How far the values of two columns coincide: for chosen pairs, or for all columns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import kinds
from tallyframe.operators.joincheck import JoinCheck, with_derived
from tallyframe.operators.keys import named
from tallyframe.session import pin, small_frame


def column_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str,
                   *, left_table: str = "left", right_table: str = "right") -> DataFrame:
    """One row: both sides' counts, shared values, and a coverage each way."""
    check = JoinCheck(left, right, left_on=left_column, right_on=right_column)
    shown = []
    for s, table, column, kind in (
        ("l", left_table, left_column, check.plan.left_kinds[0]),
        ("r", right_table, right_column, check.plan.right_kinds[0]),
    ):
        word = "left" if s == "l" else "right"
        shown += [
            f"{_quoted(table)} AS {word}_table",
            f"{_quoted(column)} AS {word}_column",
            f"{s}_rows AS {word}_n_rows",
            f"{s}_null_rows AS {word}_n_null",
            f"{s}_distinct AS {word}_n_distinct",
            f"'{kind}' AS {word}_type",
        ]
    return with_derived(check.measures()).selectExpr(
        *shown,
        "n_shared_keys AS n_shared_values",
        "n_left_only_keys AS n_left_only_values",
        "n_right_only_keys AS n_right_only_values",
        "left_coverage",
        "right_coverage",
        f"{str(check.plan.comparable).lower()} AS comparable_types",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def measure_overlaps(tables: dict[str, DataFrame], pairs: list[dict]) -> DataFrame:
    """Every pair measured, in one frame, each with the reason it was asked for.

    A pair is ``left, left_column, right, right_column, reason``. Pairs that share a
    column share its scan and shuffle.
    """
    if not pairs:
        raise ValueError("no pairs to measure")
    frames = []
    for pair in pairs:
        absent = [k for k in ("left", "left_column", "right", "right_column") if not pair.get(k)]
        if absent:
            raise ValueError(f"a pair needs {', '.join(absent)}")
        reason = (pair.get("reason") or "").strip()
        if not reason:
            raise ValueError("a pair needs the reason it is worth comparing")
        for end in ("left", "right"):
            if pair[end] not in tables:
                raise ValueError(f"no table {pair[end]!r}; tables: {', '.join(sorted(tables))}")
        measured = column_overlap(
            tables[pair["left"]], pair["left_column"], tables[pair["right"]],
            pair["right_column"], left_table=pair["left"], right_table=pair["right"],
        )
        frames.append(measured.withColumn("asked_because", F.lit(reason)))
    return reduce(DataFrame.unionByName, frames)


LONG_VALUE = 64  # bytes; longer text is compared by its digest


def all_overlaps(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Every pair of columns of one kind, of the same or of different tables: a row as of ``column_overlap``.

    One pass per table and one shuffle for all: cells become (kind, value) with a count
    per column, equal ones are added up before they are sent, and what arrives is a row
    per distinct value. Values then only matter by the set of columns that hold them, so
    pairs are counted from the sets. Whole numbers are compared as such, with fractions as
    doubles. Nested columns are left out.
    """
    listed = [(t, c, tables[t].schema[c].dataType) for t in tables for c in (columns or {}).get(t, tables[t].columns)]
    slots: dict[str, list[tuple[int, str, str]]] = {}  # per way of comparing, the columns compared so
    kept = []
    for table, column, dtype in listed:
        kind = kinds.key_kind(dtype)
        if kinds.is_nested(dtype):
            continue
        number = len(kept)
        kept.append((number, table, column, kind))
        ways = [kind] if kind != kinds.NUMERIC else ["double"] + ["integer"] * (kinds.kind_of(dtype) == kinds.INTEGER)
        for way in ways:
            slots.setdefault(way, []).append((number, table, column))
    width = max(map(len, slots.values()), default=0)
    if not kept:
        raise ValueError("no columns to compare")
    cells = []
    for table, df in tables.items():
        own = [F.struct(F.lit(way).alias("way"), _value(named(df, c), df.schema[c].dataType, way).alias("v"), F.lit(at).alias("at"))
               for way, members in slots.items() for at, (_, t, c) in enumerate(members) if t == table]
        if own:
            cells.append(df.select(F.inline(F.array(*own))))
    rows = reduce(DataFrame.unionByName, cells)
    held = rows.groupBy("way", "v").agg(*[F.count_if(F.col("at") == at).alias(f"n{at}") for at in range(width)])
    # from here on a row per set of columns, however many values the columns share
    counts = [F.col(f"n{at}") for at in range(width)]
    sets = pin(held.groupBy("way", F.col("v").isNull().alias("absent"), F.array(*[c > 0 for c in counts]).alias("holds")).agg(
        F.count("*").alias("values"), *[F.sum(c).alias(f"n{at}") for at, c in enumerate(counts)]))
    sums = F.array(*[F.struct(F.lit(at).alias("at"), F.col(f"n{at}").alias("n")) for at in range(width)])
    each = sets.select("way", "absent", "values", F.explode(sums).alias("s")).where("s.n > 0").groupBy("way", "s.at").agg(
        F.sum("s.n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("absent"), F.col("s.n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(~F.col("absent"), F.col("values"))), F.lit(0)).alias("n_distinct"))
    present = F.filter(sums, lambda s: s["n"] > 0)
    pairs = (sets.where("NOT absent").select("way", "values", present.alias("p")).select("way", "values", "p", F.explode("p").alias("l"))
             .select("way", "values", "l", F.explode("p").alias("r")).where("l.at < r.at").groupBy("way", F.col("l.at").alias("i"), F.col("r.at").alias("j"))
             .agg(F.sum("values").alias("shared"), F.sum("l.n").alias("left_met"), F.sum("r.n").alias("right_met")))
    wanted = []
    for way, members in slots.items():
        for j, right in enumerate(members):
            for i, left in enumerate(members[:j]):
                # two columns of whole numbers were compared as such
                if way != "double" or not {left[0], right[0]} <= {n for n, *_ in slots.get("integer", [])}:
                    wanted.append((way, i, j, *left[1:], *right[1:], kept[left[0]][3]))
    asked = small_frame(rows.sparkSession, wanted, "way string, i int, j int, left_table string, left_column string, "
                                                   "right_table string, right_column string, type string")
    side = lambda s, at: each.select(F.col("way"), F.col("at").alias(at), *[F.col(c).alias(f"{s}_{c}") for c in ("n_rows", "n_null", "n_distinct")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    found = asked.join(side("left", "i"), ["way", "i"], "left").join(side("right", "j"), ["way", "j"], "left").join(
        pairs, ["way", "i", "j"], "left")
    numbers = [f"{s}_{c}" for s in ("left", "right") for c in ("n_rows", "n_null", "n_distinct")] + ["shared", "left_met", "right_met"]
    found = found.select(*asked.columns, *map(zero, numbers))
    return found.selectExpr(
        "left_table", "left_column", "left_n_rows", "left_n_null", "left_n_distinct", "type AS left_type",
        "right_table", "right_column", "right_n_rows", "right_n_null", "right_n_distinct", "type AS right_type",
        "shared AS n_shared_values", "left_n_distinct - shared AS n_left_only_values", "right_n_distinct - shared AS n_right_only_values",
        "CASE WHEN left_n_rows > 0 THEN left_met / left_n_rows ELSE 0D END AS left_coverage",
        "CASE WHEN right_n_rows > 0 THEN right_met / right_n_rows ELSE 0D END AS right_coverage", "true AS comparable_types")


def _value(column, dtype, way: str):
    """A cell as the text its kind is compared by; equal values, and only they, give equal texts."""
    if way == "double":
        return (column.cast("double") + F.lit(0.0)).cast("string")  # no negative zero
    if way == kinds.DATETIME:
        return F.unix_micros(column.cast("timestamp")).cast("string")
    text = kinds.as_text(column, dtype)
    if way != kinds.STRING:
        return text
    return F.when(F.octet_length(text) <= LONG_VALUE, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def overlap_records(measured: DataFrame, fingerprints: DataFrame, measured_at=None) -> DataFrame:
    """What is kept of each measurement, with the state of both tables it was taken from.

    ``fingerprints`` is ``table, fingerprint``; a table without one keeps null.
    """
    stamp = F.current_timestamp() if measured_at is None else F.lit(measured_at)
    at = lambda side: fingerprints.select(
        F.col("table").alias(f"{side}_table"), F.col("fingerprint").alias(f"{side}_fingerprint")
    )
    return (
        measured.join(at("left"), "left_table", "left")
        .join(at("right"), "right_table", "left")
        .select(
            "left_table", "left_column", "right_table", "right_column", "n_shared_values",
            "left_coverage", "right_coverage", "comparable_types", "asked_because",
            stamp.cast("timestamp").alias("measured_at"), "left_fingerprint", "right_fingerprint",
        )
    )
