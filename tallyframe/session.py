"""Session settings the engine relies on, and the places it may cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Runtime settings only: the caller owns the session, so nothing here needs a
# restart. Column names are compared case-sensitively throughout.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # branches of a union are independent here and should not share one task
    "spark.sql.unionOutputPartitioning": "false",
    # a SQL step must not reach files by path; spark.read still can
    "spark.sql.runSQLOnFiles": "false",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller made; they stay set."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the configured one, else one beside the warehouse's tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder there. It goes when the application ends, on errors too."""
    context = spark.sparkContext
    path = f"{checkpoint_dir(spark)}/tallyframe-{context.applicationId}"
    if path not in _OWN:
        hadoop = context._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _OWN.add(path)
    return path


_OWN: set[str] = set()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of every job go as soon as the job is done: for results that are not computed again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


TASK_BYTES = 8 << 20  # of files or shuffled rows that a task takes up within ``small_tasks``


@contextmanager
def small_tasks(spark: SparkSession, size: int):
    """Within it, jobs over ``size`` bytes take them up in small pieces: for tasks that hold what they group or sort."""
    width = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = {"spark.sql.files.maxPartitionBytes": str(TASK_BYTES), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
              "spark.sql.shuffle.partitions": str(max(int(width), -(-size // TASK_BYTES)))}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared checkpoint folder.

    Used where several jobs read one produced table. A written table cuts the
    lineage, survives lost executors, and later readers still load only the
    columns they need. It lives as long as the application; the shuffles it was
    computed with go at once, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/pinned-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """The pinned frame and how many rows it has, counted as they were written."""
    seen = Observation()
    table = pin(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def hold(df: DataFrame) -> DataFrame:
    """Keep a frame for the length of one report; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def small_frame(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """Rows already on the driver (one per column, step or key shown) as a frame.

    Goes through Arrow, so Spark holds it as a local relation and needs no job to
    read it.
    """
    struct = _parsed(schema) if isinstance(schema, str) else schema
    names = struct.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct)
    )
    return spark.createDataFrame(table, schema=struct)


@lru_cache(maxsize=64)
def _parsed(schema: str) -> StructType:
    return StructType.fromDDL(schema)
