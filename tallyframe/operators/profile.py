"""Profile a table: one row of facts per column.

Two kinds of job over a few columns each, several side by side. The first is one
global aggregate of everything that needs no grouping. The second counts the equal
values of every column, combining before the shuffle; distinct counts, modal values,
the smallest samples and (for columns of few enough values) quartiles are all read
from those counts. In a tall table every column is a branch that reads nothing else,
in a short one the columns of a type go through together, since there planning costs
more than reading. Inputs that are no columnar file are held for the profile.

Long text is shuffled as a digest of the whole value plus its leading characters
for ordering, so a column of documents moves tens of bytes per row. Where such a
value is itself an answer, it is looked up again in the table by exact order.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions import kinds
from tallyframe.functions.evidence import plain
from tallyframe.functions.text import flag_list, number_sql, ratio, strip_sql
from tallyframe.operators.quartiles import (
    PROBABILITIES,
    between,
    distributed_quartiles,
    wanted_ranks,
)
from tallyframe.session import hold, small_frame

SAMPLE_VALUES = 3
HIGH_NULL_RATE = 0.5
HIGH_CARDINALITY_RATE = 0.9
NUMERIC_TEXT_RATE = 0.9

# Text beyond this many characters travels as digest and leading characters.
LONG_TEXT = 64
# Distinct values of a column that one task may sort to find its quartiles.
QUARTILE_ROWS = 1_000_000
# Columns per job, and how many jobs run side by side. Columns of a short table are
# counted many at a time, those of a tall one each in its own branch.
SCALARS_PER_JOB = 12
COLUMNS_PER_JOB = 8
SHORT_COLUMNS_PER_JOB = 64
JOBS_AT_ONCE = 6

COLUMN_SCHEMA = (
    "position int, name string, dtype string, kind string, n_rows bigint, n_non_null bigint, "
    "n_distinct bigint, samples array<string>, min string, max string, mean double, std double, "
    "q25 double, median double, q75 double, top string, top_freq bigint, "
    "n_whitespace bigint, n_numeric bigint"
)


def positional(df: DataFrame) -> DataFrame:
    """The table with columns named c0, c1, ...: free of quoting and collisions."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def profile(
    df: DataFrame,
    *,
    sample_values: int = SAMPLE_VALUES,
    long_text: int = LONG_TEXT,
    quartile_rows: int = QUARTILE_ROWS,
    columns_per_job: int | None = None,
    columnar: bool = True,
) -> DataFrame:
    """One row per column, in schema order. See :func:`with_rules` for the schema.

    ``columnar=False`` says that ``df`` is costly to read one column at a time (a
    text file, or the result of a join): it is then computed once and held.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    table = positional(df) if columnar else hold(positional(df))
    try:
        # a job over few columns leaves executors idle while it is planned
        with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
            facts: dict = {"n_rows": 0}
            for found in pool.map(partial(_scalars, table, fields), _batches(len(fields), SCALARS_PER_JOB)):
                facts |= found
            n_rows = facts["n_rows"] if fields else df.count()
            tall = n_rows > quartile_rows
            per_job = columns_per_job or (COLUMNS_PER_JOB if tall else SHORT_COLUMNS_PER_JOB)
            measure = partial(
                _measure, table, fields, facts, sample_values, long_text, quartile_rows, tall
            )
            rows = [r for found in pool.map(measure, _batches(len(fields), per_job)) for r in found]
    finally:
        if not columnar:
            table.unpersist()
    return with_rules(small_frame(spark, rows, COLUMN_SCHEMA))


def _batches(n: int, size: int) -> list[range]:
    return [range(start, min(start + size, n)) for start in range(0, n, size)]


def _measure(table, fields, facts, k: int, long_text: int, quartile_rows: int, tall: bool, columns):
    """The measured row of each of a few columns."""
    filled = {i: facts[f"c{i}_non_null"] for i in columns if facts[f"c{i}_non_null"]}
    ranged = [i for i in filled if kinds.kind_of(fields[i].dataType) in kinds.RANGED]
    bounded = _few_values(table, ranged, quartile_rows) if tall else set(ranged)
    values = _value_facts(table, fields, filled, k, long_text, bounded, tall)
    wide = {i: filled[i] for i in ranged if i not in bounded}
    for i, quartiles in distributed_quartiles(table, wide, limit=quartile_rows).items():
        values[i]["quartiles"] = quartiles
    return [_row(i, fields[i], facts["n_rows"], facts, values.get(i, {})) for i in columns]


def profile_dict(df: DataFrame, **options) -> dict:
    """The profile as plain values, the shape a catalog entry or a log keeps."""
    rows = profile(df, **options).orderBy("position").collect()
    columns = []
    for row in map(lambda r: plain(r), rows):
        numeric = row["kind"] in kinds.RANGED
        skip = {"position", "kind", "n_rows", "n_non_null", "n_whitespace", "n_numeric"}
        spread = {"min", "max", "mean", "std", "q25", "median", "q75"}
        modal = {"top", "top_freq"}
        drop = skip | (modal if numeric else spread)
        if not row["n_non_null"] or row["kind"] == kinds.BOOLEAN:
            drop |= spread | modal
        columns.append({k: v for k, v in row.items() if k not in drop})
    return {
        "n_rows": rows[0]["n_rows"] if rows else df.count(),
        "n_cols": len(columns),
        "candidate_keys": [c["name"] for c in columns if "possible_key" in c["flags"]],
        "columns": columns,
    }


# --- the first job: everything scalar -------------------------------------------


def _scalars(table: DataFrame, fields, columns) -> dict:
    aggregates = ["count(1) AS n_rows"]
    for i in columns:
        aggregates.append(f"count(c{i}) AS c{i}_non_null")
        if kinds.kind_of(fields[i].dataType) in kinds.RANGED:
            aggregates += [
                f"CAST(min(c{i}) AS STRING) AS c{i}_min",
                f"CAST(max(c{i}) AS STRING) AS c{i}_max",
                f"CAST(avg(c{i}) AS DOUBLE) AS c{i}_mean",
                f"stddev_samp(c{i}) AS c{i}_std",
            ]
    return table.agg(*map(F.expr, aggregates)).first().asDict()


def _few_values(table: DataFrame, columns: list[int], limit: int) -> set[int]:
    """Columns whose distinct values one task can sort.

    An estimate, which decides only where quartiles are computed: every reported
    count is exact.
    """
    if not columns:
        return set()
    row = table.agg(*[F.approx_count_distinct(f"c{i}").alias(f"c{i}") for i in columns]).first()
    return {i for i in columns if row[f"c{i}"] * 1.25 <= limit}


# --- the second job: the counts of equal values -----------------------------------
#
# Written as SQL text: a profile has a few branches per column, and one statement
# is analysed once where chained frames would be analysed at every call.

_NONE = {"value": "string", "number": "double", "long": "boolean"}
_FACT = ("what", "ord", "value", "number", "long", "n", "seen", "spaced", "numeric")


def counts_sql(view: str, members: list[int], fields, long_text: int) -> str:
    """``pos, v, digest, marks, n``: every distinct non-null value of columns of one type.

    ``marks`` is a function of the value, so grouping by it changes nothing.
    """
    first = fields[members[0]].dataType
    text = kinds.kind_of(first) in (kinds.STRING, kinds.OTHER)
    value = {}
    for i in members:
        dtype = fields[i].dataType
        widened = f"CAST(c{i} AS BIGINT)" if kinds.kind_of(dtype) == kinds.INTEGER else f"c{i}"
        value[i] = kinds.text_sql(f"c{i}", dtype) if text else widened
    if len(members) == 1:
        i = members[0]
        source = f"(SELECT {i} AS pos, {value[i]} AS x FROM {view} WHERE c{i} IS NOT NULL)"
    else:
        cells = ", ".join(f"struct({i} AS pos, {value[i]} AS x)" for i in members)
        source = f"(SELECT inline(array({cells})) FROM {view})"
    if not text:
        return (
            "SELECT pos, x AS v, CAST(NULL AS BINARY) AS digest, count(1) AS n "
            f"FROM {source} WHERE x IS NOT NULL GROUP BY pos, x"
        )
    long = f"length(x) > {long_text}"
    return (
        "SELECT pos, v, digest, marks, count(1) AS n FROM (SELECT pos, "
        f"CASE WHEN {long} THEN left(x, {long_text}) ELSE x END AS v, "
        f"CASE WHEN {long} THEN unhex(sha2(x, 256)) END AS digest, "
        f"CASE WHEN {long} THEN {_marks('x')} END AS marks "
        f"FROM {source} WHERE x IS NOT NULL) GROUP BY pos, v, digest, marks"
    )


def _marks(x: str) -> str:
    """1 where spaces surround the text, plus 2 where it reads as a number."""
    return (
        f"(CASE WHEN {x} <> {strip_sql(x)} THEN 1 ELSE 0 END"
        f" + CASE WHEN {number_sql(x)} IS NOT NULL THEN 2 ELSE 0 END)"
    )


def _branch(source: str, **cells: str) -> str:
    shown = [
        f"CAST({cells.get(name, 'NULL')} AS {_NONE.get(name, 'bigint')}) AS {name}"
        for name in _FACT[1:]
    ]
    return f"SELECT pos, '{cells['what']}' AS what, {', '.join(shown)} FROM {source}"


def _ranked_branch(name: str, present: dict[int, int], k: int) -> str:
    """The smallest values, the wanted ranks and the last row of each numeric column.

    One task sorts the distinct values of a column, about QUARTILE_ROWS at most.
    """
    sizes = ", ".join(f"{i}, {n}L" for i, n in present.items())
    ranked = (
        f"(SELECT pos, v, n, row_number() OVER w AS rn, sum(n) OVER w AS seen, "
        f"element_at(map({sizes}), pos) AS present FROM {name} "
        "WINDOW w AS (PARTITION BY pos ORDER BY v ROWS UNBOUNDED PRECEDING))"
    )
    hits = " OR ".join(
        f"(seen > floor((present - 1) * {p}D) AND seen - n <= ceil((present - 1) * {p}D))"
        for p in PROBABILITIES
    )
    source = f"{ranked} WHERE rn <= {k} OR seen = present OR {hits}"
    return _branch(source, what="ranked", ord="rn", value="v", number="v", n="n", seen="seen")


def _value_branches(name: str, members: list[int], kind: str, k: int) -> list[str]:
    """Distinct count with modal value, and the smallest values, of each column.

    Both read the same counts, so Spark shuffles them once. A column on its own needs
    no grouping, and keeps its smallest values in a heap per task.
    """
    inner = ["count(1) AS d", "sum(n) AS total"]
    cells = {"ord": "d", "seen": "total"}
    if kind not in kinds.RANGED and kind != kinds.BOOLEAN:
        # fewest negatives first is most frequent first; ties go to the smaller value
        inner.append("min(struct(-n AS neg, v, digest)) AS m")
        cells |= {"value": "m.v", "long": "m.digest IS NOT NULL", "n": "-m.neg"}
    if kind == kinds.STRING:
        # judged once per distinct value; long text was judged before the shuffle
        marks = f"coalesce(marks, {_marks('v')})"
        inner.append(f"sum(CASE WHEN {marks} IN (1, 3) THEN n ELSE 0 END) AS spaced")
        inner.append(f"sum(CASE WHEN {marks} >= 2 THEN n ELSE 0 END) AS numeric")
        cells |= {"spaced": "spaced", "numeric": "numeric"}
    order = "v NULLS FIRST, digest NULLS FIRST"
    ranks = f"row_number() OVER (PARTITION BY pos ORDER BY {order}) AS rn"
    if len(members) == 1:
        whole = f"(SELECT {members[0]} AS pos, {', '.join(inner)} FROM {name})"
        smallest = f"(SELECT *, {ranks} FROM (SELECT * FROM {name} ORDER BY {order} LIMIT {k}))"
    else:
        whole = f"(SELECT pos, {', '.join(inner)} FROM {name} GROUP BY pos)"
        # a rank filter this small is applied in every task before the shuffle
        smallest = f"(SELECT * FROM (SELECT *, {ranks} FROM {name}) WHERE rn <= {k})"
    return [
        _branch(whole, what="whole", **cells),
        _branch(smallest, what="sample", ord="rn", value="v", long="digest IS NOT NULL", n="n"),
    ]


def _families(fields, columns, bounded, tall: bool) -> list[list[int]]:
    """Columns counted together: of one type, and all on their own in a tall table."""
    if tall:
        return [[i] for i in columns]
    groups: dict[tuple, list[int]] = {}
    for i in columns:
        dtype = fields[i].dataType
        kind = kinds.kind_of(dtype)
        type_name = kind if kind in (kinds.INTEGER, kinds.STRING, kinds.OTHER) else dtype.simpleString()
        groups.setdefault((kind, type_name, i in bounded), []).append(i)
    return list(groups.values())


def _value_facts(table, fields, present, k, long_text, bounded, tall) -> dict[int, dict]:
    if not present:
        return {}
    spark = table.sparkSession
    view = f"profiled_{uuid.uuid4().hex}"
    counts, branches = [], []
    for members in _families(fields, present, bounded, tall):
        name = f"k{members[0]}"
        counts.append(f"{name} AS ({counts_sql(view, members, fields, long_text)})")
        if members[0] in bounded:
            branches.append(_ranked_branch(name, {i: present[i] for i in members}, k))
        else:
            kind = kinds.kind_of(fields[members[0]].dataType)
            branches += _value_branches(name, members, kind, k)
    table.createOrReplaceTempView(view)
    try:
        statement = f"WITH {', '.join(counts)} {' UNION ALL '.join(branches)}"
        rows = spark.sql(statement).collect()  # a few rows per column
    finally:
        spark.catalog.dropTempView(view)
    by_column: dict[int, list] = {i: [] for i in present}
    for row in rows:
        by_column[row["pos"]].append(row)
    return {
        i: _decode(by_column[i], table, i, fields[i].dataType, present[i], k, long_text)
        for i in present
    }


def _decode(rows, table, i: int, dtype, present: int, k: int, long_text: int) -> dict:
    ranked = sorted((r for r in rows if r["what"] == "ranked"), key=lambda r: r["ord"])
    if ranked:
        at = lambda rank: next(r["number"] for r in ranked if r["seen"] > rank)
        return {
            "n_distinct": ranked[-1]["ord"],
            "samples": [r["value"] for r in ranked if r["ord"] <= k],
            "quartiles": [between(at(lo), at(hi), w) for lo, hi, w in wanted_ranks(present)],
        }
    whole = next(r for r in rows if r["what"] == "whole")
    samples = [r for r in rows if r["what"] == "sample"]
    samples.sort(key=lambda r: r["ord"])
    facts = {
        "n_distinct": whole["ord"],
        "top": whole["value"],
        "top_freq": whole["n"],
        "samples": [r["value"] for r in samples],
        "spaced": whole["spaced"],
        "numeric": whole["numeric"],
    }
    text = kinds.as_text(F.col(f"c{i}"), dtype)
    if whole["long"]:
        facts["top"] = _long_modal(table, text, whole, long_text)
    if any(r["long"] for r in samples):
        bound = max((r["value"] for r in samples), key=lambda v: v.encode())
        facts["samples"] = _long_samples(table, text, bound, k, long_text)
    return facts


def _long_modal(table: DataFrame, column: Column, modal, long_text: int) -> str:
    """The smallest whole text among those as frequent as the modal one."""
    sharing = table.select(column.alias("t")).where(
        (F.left("t", F.lit(long_text)) == modal["value"]) & (F.length("t") > long_text)
    )
    if modal["n"] > 1:
        sharing = sharing.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        sharing = sharing.where(F.col("n") == modal["n"])
    return sharing.agg(F.min("t")).first()[0]


def _long_samples(table: DataFrame, column: Column, bound: str, k: int, long_text: int) -> list:
    """The k smallest distinct texts, among those that begin at or below the bound."""
    near = table.select(column.alias("t")).where(F.left("t", F.lit(long_text)) <= bound)
    return [r[0] for r in near.distinct().orderBy("t").limit(k).collect()]


def _row(i: int, field, n_rows: int, facts: dict, values: dict) -> tuple:
    kind = kinds.kind_of(field.dataType)
    present = facts[f"c{i}_non_null"]
    quartiles = values.get("quartiles") or [None, None, None]
    modal = present and kind not in kinds.RANGED and kind != kinds.BOOLEAN
    get = lambda name: facts.get(f"c{i}_{name}")
    return (
        i,
        field.name,
        field.dataType.simpleString(),
        kind,
        n_rows,
        present,
        values.get("n_distinct", 0),
        values.get("samples", []),
        get("min"),
        get("max"),
        get("mean"),
        get("std"),
        *quartiles,
        values["top"] if modal else None,
        values["top_freq"] if modal else None,
        values.get("spaced") or 0,
        values.get("numeric") or 0,
    )


# --- the rules ------------------------------------------------------------------


def semantic_label() -> Column:
    """`empty`, the kind itself, or text against categorical by cardinality."""
    dense = F.col("n_distinct") / F.col("n_non_null") >= HIGH_CARDINALITY_RATE
    return (
        F.when(F.col("n_non_null") == 0, "empty")
        .when(~F.col("kind").isin(kinds.STRING, kinds.OTHER), F.col("kind"))
        .when(dense, "text")
        .otherwise("categorical")
    )


def column_flags() -> Column:
    """What is notable about a column, from its counts alone, in a fixed order."""
    n, present, distinct = F.col("n_rows"), F.col("n_non_null"), F.col("n_distinct")
    text = F.col("kind") == kinds.STRING
    flags = flag_list(
        ("constant", distinct == 1),
        ("possible_key", (present == n) & (distinct == n)),
        ("high_null", (n - present) >= n * F.lit(HIGH_NULL_RATE)),
        ("mixed_types", text & (F.col("n_numeric") > 0) & (F.col("n_numeric") < present)),
        ("leading_trailing_whitespace", text & (F.col("n_whitespace") > 0)),
        ("numeric_stored_as_text", text & (F.col("n_numeric") / present >= NUMERIC_TEXT_RATE)),
        ("high_cardinality", text & (distinct / present >= HIGH_CARDINALITY_RATE)),
    )
    return F.when(present > 0, flags).otherwise(F.array(F.lit("all_null")))


def with_rules(counts: DataFrame) -> DataFrame:
    """Rates, label and flags added to the measured counts."""
    return counts.select(
        "position",
        "name",
        "dtype",
        "kind",
        semantic_label().alias("inferred"),
        "n_rows",
        "n_non_null",
        (F.col("n_rows") - F.col("n_non_null")).alias("n_null"),
        ratio(F.col("n_rows") - F.col("n_non_null"), F.col("n_rows")).alias("null_rate"),
        "n_distinct",
        ratio(F.col("n_distinct"), F.col("n_non_null")).alias("distinct_rate"),
        "samples",
        "min",
        "max",
        "mean",
        "std",
        "q25",
        "median",
        "q75",
        "top",
        "top_freq",
        "n_whitespace",
        "n_numeric",
        column_flags().alias("flags"),
    )


def candidate_keys(profiled: DataFrame) -> DataFrame:
    """Columns that are non-null and distinct in every row."""
    return profiled.where(F.array_contains("flags", "possible_key")).select("position", "name")


def null_rates(df: DataFrame) -> DataFrame:
    """``position, name, n_rows, n_null, null_rate`` from one pass over the table."""
    table = positional(df)
    counted = table.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in table.columns]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"),
        )
        for i, name in enumerate(df.columns)
    ]
    if not rows:
        return counted.select(F.lit(0).alias("position"), F.lit("").alias("name"), "n_rows",
                              "n_rows", F.lit(0.0).alias("null_rate")).limit(0)
    return counted.select(F.inline(F.array(*rows))).withColumn(
        "null_rate", ratio(F.col("n_null"), F.col("n_rows"))
    )
