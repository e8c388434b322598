"""Data files: finding them, their size and age, and whether a record went stale."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIXES = (".csv", ".parquet")


def suffix_of(path: str) -> str:
    """The format suffix of a path, or a clear error naming the supported ones."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no reader for {suffix or path!r}; supported: {', '.join(SUFFIXES)}")
    return suffix


def stem_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, mtime`` per file at a path, folder or glob. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def find_data_files(spark: SparkSession, target: str) -> list[str]:
    """Supported files at a file, folder (not below it) or glob, in name order.

    Listing goes through the file system Spark reads from, local or remote.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = fs.globStatus(path) or []
    found = []
    for status in statuses:
        name = status.getPath().toString()
        known = PurePosixPath(name).suffix.lower() in SUFFIXES
        if known or status.isFile():
            found.append(name)  # a folder named x.parquet is one dataset
        else:
            found += [child.getPath().toString() for child in fs.listStatus(status.getPath())]
    found = sorted(n for n in found if PurePosixPath(n).suffix.lower() in SUFFIXES)
    if not found:
        raise ValueError(f"no data files at {target!r} ({', '.join(SUFFIXES)})")
    return found


def dataset_facts(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """``source, size, mtime, fingerprint`` per named source; missing ones have no row.

    A source of many files counts as changed when its total size or newest file does.
    """
    frames = []
    for name, path in sources.items():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.globStatus(hadoop):
            continue
        frames.append(
            file_facts(spark, path)
            .agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
            .select(F.lit(name).alias("source"), "size", "mtime")
        )
    if not frames:
        return spark.createDataFrame(
            [], "source string, size bigint, mtime timestamp, fingerprint string"
        )
    facts = frames[0]
    for frame in frames[1:]:
        facts = facts.unionByName(frame)
    return facts.where(F.col("size").isNotNull()).withColumn(
        "fingerprint", fingerprint(F.col("size"), F.col("mtime"))
    )


def fingerprint(size, mtime):
    """Size and change time as one comparable text; null when either is unknown."""
    return F.concat(size.cast("string"), F.lit(":"), F.unix_micros(mtime).cast("string"))


def stale_sources(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``source, stale`` for every recorded source.

    Stale when the size or change time differs, or when the file is gone. When the
    record was taken says nothing about the file and is not compared. A source with
    nothing recorded makes no claim and is not stale.
    """
    now = current.select("source", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    claims = F.col("size").isNotNull() & F.col("mtime").isNotNull()
    same = F.col("size").eqNullSafe(F.col("size_now")) & F.col("mtime").eqNullSafe(F.col("mtime_now"))
    return recorded.join(now, "source", "left").select("source", (claims & ~same).alias("stale"))
