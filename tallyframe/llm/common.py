"""What the operators share: reading, row batches, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.session import checkpoint_dir, pin

__all__ = ["checkpoint_dir", "components", "pin", "read", "same"]

# Rows of one Arrow batch; texts may be long, so batches are short.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Python tasks get few rows at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def same(left: DataFrame, right: DataFrame, *names: str):
    """Join condition: the named columns agree, nulls included."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node.

    Alternating large and small stars, each a minimum by node and a join on that
    node. A hub costs one row per neighbour in a join that adaptive execution can
    split. Every step is written to the shared folder. Nodes that only link to
    themselves, and null ends, are left out.
    """
    links = pin(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.selectExpr("a AS node", "b AS root").union(
                links.selectExpr("b AS node", "b AS root").distinct())
        before = state
        both = pin(links.union(links.selectExpr("b AS a", "a AS b")))
        links = _star(both, "b > a", keep_self=False)
        links = _star(links, "true", keep_self=True)


def _star(links: DataFrame, larger: str, keep_self: bool) -> DataFrame:
    """Point the chosen neighbours of every node, or the node too, at the least of them."""
    least = pin(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    moved = links.where(larger).join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b")
    if keep_self:
        moved = moved.union(least.selectExpr("a", "m AS b"))
    return pin(moved.where("a <> b").distinct())
