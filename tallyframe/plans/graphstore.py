"""The project graph as it stands: versions of nodes and edges by build, and all measurements.

A build is written beside the one in use and takes its place by one rename of a small
file that names it. Readers see the former build or the new one, never parts of both, and
a build that fails leaves the former in use. Measured overlaps are only ever added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.plans.graph import EDGE_COLUMNS, NODE_COLUMNS, merge_build
from tallyframe.sources.versions import Versions


class GraphStore:
    """Nodes, edges and overlaps under one folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.path = self.versions.path

    def current(self) -> str | None:
        """The build in use, if there is one."""
        return self.versions.current()

    def _table(self, name: str, columns: dict[str, str]) -> DataFrame:
        build = self.current()
        if build is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in {**columns, "build": "string"}.items()))
        return self.spark.read.parquet(f"{self.path}/builds/{build}/{name}")

    def nodes(self) -> DataFrame:
        """Nodes of the build in use; ``build`` is the one that a node was last part of."""
        return self._table("nodes", NODE_COLUMNS)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGE_COLUMNS)

    def builds(self) -> list[str]:
        """The builds that are still there, by name."""
        return sorted(self.versions.by_age("builds"))

    def record(self, overlaps: DataFrame) -> None:
        """Add measurements (overlap edges keyed by column nodes). Nothing recorded is ever taken away."""
        overlaps.write.mode("append").parquet(f"{self.path}/overlaps")

    def overlaps(self) -> DataFrame | None:
        """The latest measurement of every directed pair."""
        if not self.versions.exists("overlaps"):
            return None
        kept = self.spark.read.parquet(f"{self.path}/overlaps")
        rest = [c for c in kept.columns if c not in ("src", "dst")]
        return kept.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "measured_at").alias("m")).select("src", "dst", "m.*")

    def publish(self, nodes: DataFrame, edges: DataFrame, build: str, keep: int = 2) -> None:
        """Make a build the one in use, and remove all but the latest ``keep`` builds.

        Nodes and edges are those of the new build, their properties too. Of former nodes
        only those stay that a measurement ends at; they keep the name of the build that
        last had them. Ids must be unique. If anything fails the former build stays in use.
        """
        if build == self.current():
            raise ValueError(f"build {build!r} is in use; give every build a name of its own")
        measured = self.overlaps()
        fresh = nodes.withColumn("build", F.lit(build))
        if measured is not None:
            fresh = merge_build(self.nodes(), fresh, measured)
        place = f"{self.path}/builds/{build}"
        fresh.write.mode("overwrite").parquet(f"{place}/nodes")
        edges.withColumn("build", F.lit(build)).write.mode("overwrite").parquet(f"{place}/edges")
        doubled = self.spark.read.parquet(f"{place}/nodes").groupBy("id").count().where("count > 1").limit(1).collect()
        if doubled:
            raise ValueError(f"build {build!r}: more than one node has the id {doubled[0].id!r}")
        former = self.current()
        self.versions.use(build)
        stay = {build, former} if keep > 1 else {build}
        there = self.versions.by_age("builds")
        for old in [b for b in there if b not in stay][:max(0, len(there) - keep)]:
            self.versions.remove("builds", old)
