"""The few ways rows leave the engine, all capped, and the one-pass measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.functions.evidence import plain

HEAD_ROWS = 10
PREVIEW_ROWS = 15
PREVIEW_COLUMNS = 12


def head(df: DataFrame, n: int = HEAD_ROWS) -> list[dict]:
    return [plain(r) for r in df.limit(n).collect()]


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, columns: int = PREVIEW_COLUMNS) -> dict:
    """The first rows and columns, with the true totals beside them."""
    shown = df.columns[:columns]
    return {
        "n_rows": df.count(),
        "n_cols": len(df.columns),
        "columns": shown,
        "rows": head(df.select(*[f"`{c}`" for c in shown]), rows),
    }


def schema_of(df: DataFrame) -> dict[str, str]:
    """Column names and types; no rows are read."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def measure(df: DataFrame, expressions: dict[str, str]) -> dict:
    """Many aggregates in one pass, by alias; nothing asked gives nothing."""
    if not expressions:
        return {}
    return df.agg(*[F.expr(e).alias(a) for a, e in expressions.items()]).first().asDict()


def scalar(df: DataFrame, expression: str):
    return df.agg(F.expr(expression)).first()[0]


def derive(df: DataFrame, *expressions: str) -> DataFrame:
    return df.selectExpr(*expressions)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_name(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
