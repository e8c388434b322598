"""Everything a run measured, as rows to append to a monitoring table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans.drift import drift_frame
from tallyframe.plans.spec import StepResult
from tallyframe.session import small_frame
from tallyframe.sources.table import PREVIEW_COLUMNS, PREVIEW_ROWS, preview

__all__ = ["append_metrics", "drift_frame", "run_metrics", "step_previews", "step_rows"]

SCHEMA = (
    "run string, model string, step_pos int, step string, op string, part string, "
    "field string, value string"
)


def _leaves(value, path=""):
    if isinstance(value, dict) and value:
        for key, item in value.items():
            yield from _leaves(item, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list) and value and isinstance(value[0], dict):
        for i, item in enumerate(value):
            yield from _leaves(item, f"{path}[{i}]")
    elif value is None or isinstance(value, str):
        yield path, value
    else:
        yield path, json.dumps(value)


def step_rows(run: str, model: str, position: int, result: StepResult):
    parts = {
        "provenance": result.provenance,
        "outcome": result.outcome,
        "drift": result.drift,
        "acknowledged": {flag: True for flag in result.acknowledged},
        "blocking": {flag: True for flag in result.blocking},
    }
    for part, content in parts.items():
        for name, value in _leaves(content):
            if name:
                yield (run, model, position, result.id, result.op, part, name, value)


def run_metrics(spark: SparkSession, run: str, model: str, results: list[StepResult]) -> DataFrame:
    """One row per (step, part, field): as many rows as things measured."""
    rows = [row for i, r in enumerate(results) for row in step_rows(run, model, i, r)]
    return small_frame(spark, rows, SCHEMA)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add runs to a table of metrics; a (run, model) that is there already is replaced, not doubled."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "model").parquet(path)


def step_previews(spark: SparkSession, run: str, model: str, results: list[StepResult], rows: int = PREVIEW_ROWS,
                  columns: int = PREVIEW_COLUMNS) -> DataFrame:
    """``run, model, step_pos, step, n_rows, n_cols, place, row``: the first rows of every step's table, as JSON."""
    out = []
    for position, result in enumerate(results):
        shown = preview(result.df, rows, columns)
        out += [(run, model, position, result.id, shown["n_rows"], shown["n_cols"], place + 1, json.dumps(row, ensure_ascii=False))
                for place, row in enumerate(shown["rows"])]
    return small_frame(spark, out, "run string, model string, step_pos int, step string, n_rows bigint, n_cols int, place int, row string")
