"""Ordered passes: a table range-partitioned into sorted cells, and what one cell hands the next.

A key of any number of rows is spread over cells, as the order goes on below the key. What
a pass carries along a key (a last row, a running sum) is carried within each cell, and
only the state at a cell's end crosses to later ones: one row a cell.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import pin

CELL, PLACE = "__cell", "__place"


def in_cells(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt by ranges of ``order`` and sorted, each with the number of its cell.

    Cells are numbered in order. One shuffle. The caller writes the result before it is
    read twice, since another run may draw other ranges.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(CELL, F.spark_partition_id())


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Every row with, for each ``{name: column}``, the sum of the column up to the row, along its key.

    Rows that tie in ``order`` share one sum, that of all up to and with them; they always
    lie in one cell, so tables with many ties are grouped first. Nulls of keys are equal,
    nulls of the columns count as nothing; a sum of nothing is null.
    """
    cells = pin(in_cells(df, [F.col(c) for c in [*keys, *order]]))
    along = Window.partitionBy(CELL, *keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    run = cells.withColumns({n: F.sum(c).over(along) for n, c in sums.items()})
    within = cells.groupBy(CELL, *keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    # only a cell's first key can have begun in an earlier one: a row a cell at the most
    handed = pin(within.select(
        F.col(CELL).alias("__c"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.count("*").over(earlier).alias("__before"), *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums])
        .where("__before > 0").drop("__before"))
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(CELL) == F.col("__c"))
    added = {n: F.when(F.col(f"__{n}").isNull(), F.col(n)).otherwise(F.col(f"__{n}") + F.coalesce(F.col(n), F.col(f"__{n}") - F.col(f"__{n}")))
             for n in sums}
    return run.join(handed, match, "left").withColumns(added).select(*df.columns, *sums)
