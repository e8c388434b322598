"""Event logs: JSON lines, a header first, one event per line after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HEADER = "header"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``log, seq, kind, data``: every well-formed line of every file.

    ``seq`` orders the lines of one file: the start of the block a task read, then
    the line's place within it. Lines that are not an object with a kind are left
    out, a truncated last line among them.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
        F.from_json("value", "kind string, data string").alias("event"),
    )
    return lines.where(F.col("event.kind").isNotNull()).select(
        "log", "seq", F.col("event.kind").alias("kind"), F.col("event.data").alias("data")
    )
