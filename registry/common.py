"""Shared helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.session import prepare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commas(column) -> Column:
    return F.array_join(column, ",")


def rounded(name: str, places: int = 6) -> Column:
    return F.round(F.col(name), places).alias(name)


def sql_flags(*pairs: tuple[str, str]) -> str:
    """DuckDB text for the names whose condition holds, joined by commas."""
    marks = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in pairs)
    return f"concat_ws(',', {marks})"
