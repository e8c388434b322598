"""One row per key, chosen column by column, with the evidence counted.

A rule per column says whose value survives: of the first or last row in a declared order
that has one, the least, the largest, the most frequent. All but the last are one
aggregate whose state is a row, merged before the shuffle, so a key with a third of all
rows costs what any other does; frequencies are counted per value first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators import keys as K
from tallyframe.session import pin

RULES = ("first", "last", "min", "max", "most_frequent")


@dataclass
class Deduped:
    """The surviving rows and the evidence they were chosen on."""

    df: DataFrame
    groups: DataFrame
    keys: tuple[str, ...]
    rules: dict[str, str]
    source: DataFrame

    def report(self) -> DataFrame:
        """One row: rows in, kept and dropped, rows without a key, keys, and keys that had several rows."""
        zero = F.lit(0).cast("bigint")
        counted = self.groups.agg(
            F.coalesce(F.sum("n"), zero).alias("keyed"), F.count("*").alias("n_keys"),
            F.count_if(F.col("n") > 1).alias("n_duplicated_keys"), F.coalesce(F.max("n"), zero).alias("max_key_multiplicity"))
        alone = _alone(self.source, self.keys).agg(F.count("*").alias("n_null_keys"))
        both = counted.unionByName(alone, allowMissingColumns=True).agg(
            *[F.max(c).alias(c) for c in (*counted.columns, "n_null_keys")])
        return both.select(
            (F.col("keyed") + F.col("n_null_keys")).alias("input_rows"), (F.col("n_keys") + F.col("n_null_keys")).alias("result_rows"),
            (F.col("keyed") - F.col("n_keys")).alias("rows_dropped"), "n_null_keys", "n_keys", "n_duplicated_keys",
            "max_key_multiplicity")

    def conflicts(self) -> DataFrame:
        """A row per column: ``column, rule``, keys whose rows differ in it, and keys whose own first row had no value though others did."""
        names = list(self.rules)
        if not names:  # nothing beside the key, so nothing to differ in
            return self.groups.sparkSession.createDataFrame([], "column string, rule string, n_conflicts bigint, n_filled bigint")
        rows = self.groups.agg(*[F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(names))],
                               *[F.count_if(f"f{i}").alias(f"f{i}") for i in range(len(names))])
        return rows.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("column"), F.lit(self.rules[name]).alias("rule"),
                     F.col(f"c{i}").alias("n_conflicts"), F.col(f"f{i}").alias("n_filled")) for i, name in enumerate(names)])))

    def provenance(self) -> dict:
        return {"op": "dedupe", "keys": list(self.keys), "rules": self.rules, **self.report().first().asDict(),
                "conflicts": {r["column"]: r.n_conflicts for r in self.conflicts().where("n_conflicts > 0").collect()}, "flags": []}


def dedupe(df: DataFrame, keys, order=(), rules: dict[str, str] | None = None, default: str = "first") -> Deduped:
    """One row for each distinct key; rows with a null in their key stay as they are.

    ``order`` lists column names, ``-name`` for descending; nulls come last either way.
    Rows that tie in it are ordered by a hash of all their columns, so the outcome does not
    depend on where rows lie. ``rules`` names a rule for a column, ``default`` goes for the rest:
    ``first`` and ``last`` take the first or last non-null value in the order, ``min`` and
    ``max`` the least or largest, ``most_frequent`` the value with most rows, of those that
    tie the least. A column that is null in all rows of a key stays null.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    order = (order,) if isinstance(order, str) else tuple(order)
    K.require_columns(df, keys, "given")
    others = [c for c in df.columns if c not in keys]
    rules = {c: (rules or {}).get(c, default) for c in others} | {
        c: r for c, r in (rules or {}).items() if c not in others}
    unknown = [c for c in rules if c not in others]
    if unknown or not set(rules.values()) <= set(RULES):
        raise ValueError(f"rules must be of {list(RULES)} and name columns beside the key; wrong: {unknown or rules}")
    K.require_columns(df, [c.removeprefix("-") for c in order], "given")
    nested = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    rank = F.struct(*_ranks(df, order, nested))
    present = K.all_present([K.named(df, c) for c in keys])
    read = df.where(present).select(
        *[K.named(df, c).alias(f"k{i}") for i, c in enumerate(keys)],
        *[K.named(df, c).alias(f"v{i}") for i, c in enumerate(others)], rank.alias("rank"))
    text = {i: F.to_json(f"v{i}") if c in nested else F.col(f"v{i}") for i, c in enumerate(others)}
    states: list[Column] = [F.count("*").alias("n")]
    for i, c in enumerate(others):
        value = {"first": lambda i: F.min_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("rank"))),
                 "last": lambda i: F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("rank"))),
                 "min": lambda i: F.min_by(f"v{i}", text[i]), "max": lambda i: F.max_by(f"v{i}", text[i]),
                 "most_frequent": lambda i: F.lit(None)}[rules[c]](i)
        states += [value.alias(f"v{i}"), F.coalesce(F.min(text[i]) < F.max(text[i]), F.lit(False)).alias(f"c{i}"),
                   # the row that comes first has none, another has
                   (F.min_by(F.col(f"v{i}").isNull(), "rank") & (F.count(f"v{i}") > 0)).alias(f"f{i}")]
    names = [f"k{i}" for i in range(len(keys))]
    groups = read.groupBy(*names).agg(*states)
    for i, c in enumerate(others):
        if rules[c] == "most_frequent":
            counts = read.where(F.col(f"v{i}").isNotNull()).groupBy(*names, text[i].alias("t")).agg(
                F.count("*").alias("m"), F.first(f"v{i}").alias("v"))
            most = counts.groupBy(*[F.col(n).alias(f"m{n}") for n in names]).agg(
                F.min_by("v", F.struct(-F.col("m"), "t")).alias(f"most{i}"))
            groups = groups.drop(f"v{i}").join(
                most, reduce(and_, [groups[n] == most[f"m{n}"] for n in names]), "left").drop(
                *[f"m{n}" for n in names]).withColumnRenamed(f"most{i}", f"v{i}")
    groups = pin(groups)
    at = {c: f"k{i}" for i, c in enumerate(keys)} | {c: f"v{i}" for i, c in enumerate(others)}
    survivors = groups.select(*[F.col(at[c]).alias(c) for c in df.columns])
    return Deduped(survivors.unionByName(_alone(df, keys)), groups, keys, rules, df)


def _alone(df: DataFrame, keys) -> DataFrame:
    return df.where(~K.all_present([K.named(df, c) for c in keys]))


def _ranks(df: DataFrame, order, nested) -> list[Column]:
    """The declared order, then the contents, as parts of one ascending struct."""
    out = []
    for n, name in enumerate(order):
        column = K.named(df, name.removeprefix("-"))
        out.append(column.isNull().alias(f"n{n}"))
        out.append((_reversed(column, df.schema[name[1:]].dataType) if name.startswith("-") else column).alias(f"o{n}"))
    whole = [F.to_json(K.named(df, c)) if c in nested else K.named(df, c) for c in df.columns]
    return [*out, F.xxhash64(*whole).alias("hash")]


def _reversed(column: Column, dtype) -> Column:
    """A value that sorts the other way."""
    kind = dtype.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return -F.unix_micros(column.cast("timestamp"))
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return -column.cast("decimal(20,0)") if kind == "long" else -column
    if kind == "boolean":
        return ~column
    raise ValueError(f"cannot order descending by a column of {kind}")
