"""A part of several tables in which every foreign key still resolves.

Keys of one table are chosen by a hash. Downward, every table keeps the rows that refer
to what the table above it keeps, so a kept key has all the rows it had. Upward, every
table keeps besides what kept rows refer to. Both are semi-joins on the keys alone, in the
order of the links; links that form a circle are followed until nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators import keys as K
from tallyframe.session import pin


@dataclass(frozen=True)
class Link:
    """Columns of one table that refer to columns of another."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({', '.join(self.columns)}) -> {self.parent}({', '.join(self.parent_columns)})"


def link(child: str, columns, parent: str, parent_columns=None) -> Link:
    listed = lambda names: (names,) if isinstance(names, str) else tuple(names)
    own = listed(columns)
    return Link(child, own, parent, listed(parent_columns) if parent_columns else own)


def chosen(columns: list[str], percent: int) -> Column:
    """Whether a key is among ``percent`` in a hundred, by the same hash wherever it occurs."""
    text = F.concat_ws("\x1f", *[F.col(f"`{c}`").cast("string") for c in columns])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100)) < percent


@dataclass
class Subset:
    """The kept rows of every table, and how each link fared."""

    tables: dict[str, DataFrame]
    kept: dict[str, DataFrame]
    links: list[Link]
    downward: list[Link]
    pinned: dict[str, DataFrame] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        """``table, n_rows, n_kept``, a row per table."""
        parts = []
        for name in self.tables:
            whole = self.tables[name].select(F.lit(name).alias("table"), F.lit(1).alias("w"), F.lit(0).alias("k"))
            parts += [whole, self.kept[name].select(F.lit(name).alias("table"), F.lit(0).alias("w"), F.lit(1).alias("k"))]
        none = self.kept[next(iter(self.kept))].sparkSession.createDataFrame([(n, 0, 0) for n in self.tables], "table string, w int, k int")
        return reduce(DataFrame.unionByName, parts, none).groupBy("table").agg(
            F.sum("w").alias("n_rows"), F.sum("k").alias("n_kept"))

    def audit(self) -> DataFrame:
        """A row per link: references kept, those that resolved before and do not now, and kept keys whose fan-out changed.

        ``keys_changed`` is null for links that were not followed downward: their parents
        are kept for those that refer to them, not for all that ever did.
        """
        parts = []
        for each in self.links:
            counts = lambda df: _keys(df, each.columns).groupBy(*_names(each)).agg(F.count("*").alias("n"))
            now = counts(self.kept[each.child])
            held = _keys(self.kept[each.parent], each.parent_columns).distinct().withColumn("held", F.lit(True))
            there = _keys(self.tables[each.parent], each.parent_columns).distinct().withColumn("there", F.lit(True))
            told = now.join(held, _names(each), "left").join(there, _names(each), "left").agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("references"),
                F.coalesce(F.sum(F.when(F.col("held").isNull() & F.col("there"), F.col("n"))), F.lit(0)).alias("unresolved"))
            if each in self.downward:
                before = counts(self.tables[each.child]).withColumnRenamed("n", "was")
                changed = before.join(self.whole_keys(each), _names(each), "left_semi").join(now, _names(each), "left").agg(
                    F.count_if(~F.col("was").eqNullSafe(F.col("n"))).alias("keys_changed"))
                told = told.unionByName(changed, allowMissingColumns=True)
            else:
                told = told.withColumn("keys_changed", F.lit(None).cast("bigint"))
            parts.append(told.agg(*[F.max(c).alias(c) for c in ("references", "unresolved", "keys_changed")])
                         .select(F.lit(each.name).alias("link"), "*"))
        return reduce(DataFrame.unionByName, parts)

    def whole_keys(self, each: Link) -> DataFrame:
        """Parent keys kept on the way down, which must have all their children."""
        return _keys(self.pinned[each.parent], each.parent_columns).distinct()


def subset(tables: dict[str, DataFrame], links: list[Link], root: str, keep: Column) -> Subset:
    """The rows of ``root`` that ``keep`` chooses, all that depends on them, and all that those refer to.

    A table reached downward by several links follows the first in the order given; what
    its rows refer to by the others is added upward. Null references need nothing and
    follow nothing; references that resolved nowhere before stay as they are. Tables that
    no link reaches are left empty. A circle of links ends, as every round only adds keys.
    """
    for each in links:
        for name, columns, side in ((each.child, each.columns, "child"), (each.parent, each.parent_columns, "parent")):
            if name not in tables:
                raise ValueError(f"no table {name!r}; tables: {', '.join(sorted(tables))}")
            K.require_columns(tables[name], columns, side)
        if len(each.columns) != len(each.parent_columns):
            raise ValueError(f"{each.name}: differing numbers of columns")
    if root not in tables:
        raise ValueError(f"no table {root!r}; tables: {', '.join(sorted(tables))}")
    down, downward, todo = {root: pin(tables[root].where(F.coalesce(keep, F.lit(False))))}, [], [root]
    via: dict[str, Link] = {}
    while todo:  # breadth first: the shortest way to a table counts
        parent = todo.pop(0)
        for each in links:
            if each.parent == parent and each.child not in down:
                down[each.child] = pin(_referring(tables[each.child], each, down[parent]))
                via[each.child] = each
                downward.append(each)
                todo.append(each.child)
    outside = {root: tables[root].where(~F.coalesce(keep, F.lit(False)))}
    for name, each in via.items():
        outside[name] = _referring(tables[name], each, down[each.parent], how="left_anti")
    order, circular = _children_first(tables, links)
    kept = {name: down.get(name, tables[name].limit(0)) for name in tables}
    added: dict[str, int] = {}
    while True:
        grown = False
        for name in order:
            asking = [each for each in links if each.parent == name]
            if not asking:
                continue
            rest = outside.get(name, tables[name])
            found = [(_keys(kept[each.child], each.columns).distinct(), [K.named(rest, c) for c in each.parent_columns])
                     for each in asking]
            extra = pin(_once(rest, found))
            kept[name] = down[name].unionByName(extra) if name in down else extra
            if circular:
                n = extra.count()
                grown = grown or n != added.get(name, 0)
                added[name] = n
        if not grown:
            return Subset(tables, kept, links, downward, down)


def _names(each: Link) -> list[str]:
    return [f"k{i}" for i in range(len(each.columns))]


def _keys(df: DataFrame, columns) -> DataFrame:
    """The non-null values of some columns as ``k0, ...``."""
    found = [K.named(df, c) for c in columns]
    return df.where(K.all_present(found)).select(*[c.alias(f"k{i}") for i, c in enumerate(found)])


def _referring(child: DataFrame, each: Link, parent: DataFrame, how: str = "left_semi") -> DataFrame:
    held = _keys(parent, each.parent_columns).distinct()
    match = reduce(and_, [K.named(child, c) == held[k] for c, k in zip(each.columns, _names(each))])
    return child.join(held, match, how)


def _once(rest: DataFrame, found: list) -> DataFrame:
    """Rows that any of several key sets asks for, each row once however many ask."""
    marked = rest
    for n, (wanted, columns) in enumerate(found):
        names = [f"__w{n}_{i}" for i in range(len(columns))]
        asked = wanted.toDF(*names).withColumn(f"__asked{n}", F.lit(True))
        marked = marked.join(asked, reduce(and_, [c == asked[w] for c, w in zip(columns, names)]), "left").drop(*names)
    flags = [F.col(f"__asked{n}") for n in range(len(found))]
    return marked.where(F.coalesce(*flags, F.lit(False))).drop(*[f"__asked{n}" for n in range(len(found))])


def _children_first(tables, links: list[Link]) -> tuple[list[str], bool]:
    """Tables with all that refer to a table before it; whether links go round in a circle."""
    order, left = [], list(tables)
    while left:
        free = [t for t in left if not any(e.parent == t and e.child in left and e.child != t for e in links)]
        if not free:
            return order + left, True
        order += free
        left = [t for t in left if t not in free]
    return order, any(e.parent == e.child for e in links)
