"""Writers: executors write their own partitions; nothing passes the driver.

A table is written beside its place and takes it when it is whole. A job that fails leaves
the former table as it was, and one that reads the table it writes reads the former.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyframe.sources.files import suffix_of


def _in_place(df: DataFrame, path: str, mode: str, write: Callable[[str], None]) -> str:
    if mode != "overwrite":
        write(path)
        return path
    path = path.rstrip("/")
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    place, mark = hadoop.Path(path), uuid.uuid4().hex
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    beside, former = hadoop.Path(f"{path}.new-{mark}"), hadoop.Path(f"{path}.old-{mark}")
    try:
        write(str(beside.toString()))
        if files.exists(place):
            files.rename(place, former)
        if not files.rename(beside, place):
            raise OSError(f"could not move the table written to {beside.toString()} to {path}")
    finally:
        if files.exists(former) and not files.exists(place):
            files.rename(former, place)
        for left in (beside, former):
            if files.exists(left):
                files.delete(left, True)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    # Spark's own defaults would trim text and cut timestamps to milliseconds
    stamp = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    writer = df.write.mode(mode).options(timestampFormat=stamp, timestampNTZFormat=stamp)
    return _in_place(df, path, mode, lambda place: writer.csv(
        place, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    return _in_place(df, path, mode, lambda place: df.write.mode(mode).option("compression", "zstd").parquet(place))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write by suffix, to a folder of that name."""
    return {".csv": write_csv, ".parquet": write_parquet}[suffix_of(path)](df, path, mode)


def write_output(df: DataFrame, folder: str, model: str, fmt: str = "parquet") -> str:
    """A model's one table, at ``<folder>/<model>.<format>``."""
    return write_table(df, f"{folder.rstrip('/')}/{model}.{fmt}")
