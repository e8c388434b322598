"""Steps as Spark SQL text: one CREATE TABLE AS SELECT per model, a CTE per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from tallyframe.functions import kinds
from tallyframe.functions.text import number_sql, strip_sql

_JOIN_WORDS = {"inner": "INNER JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN",
               "outer": "FULL OUTER JOIN"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_sql(joined, left: str, right: str) -> str:
    """The join step as a SELECT over its inputs' names."""
    plan, keys = joined.check.plan, joined.check.keys

    def side(alias: str, column: str, as_text: bool) -> str:
        dtype = getattr(joined.check, "left" if alias == "l" else "right").schema[column].dataType
        expression = f"{alias}.{quoted(column)}"
        return kinds.text_sql(expression, dtype) if as_text else expression

    reads = []
    for c in joined.columns:
        as_text = not plan.comparable and c.left is not None and c.right is not None
        parts = [side(a, n, as_text) for a, n in (("l", c.left), ("r", c.right)) if n is not None]
        value = parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"
        reads.append(f"{value} AS {quoted(c.name)}")
    matches = " AND ".join(
        f"{side('l', a, not plan.comparable)} = {side('r', b, not plan.comparable)}"
        for a, b in zip(keys.left, keys.right)
    )
    return (
        f"SELECT {', '.join(reads)} FROM {quoted(left)} AS l "
        f"{_JOIN_WORDS[joined.how]} {quoted(right)} AS r ON {matches}"
    )


def _transform_sql(op: str, value: str, dtype: T.DataType) -> tuple[str, T.DataType]:
    text = kinds.text_sql(value, dtype)
    if op == "strip":
        return strip_sql(text), T.StringType()
    if op == "lower":
        return f"lower({text})", T.StringType()
    if op == "to_string":
        return text, T.StringType()
    kind = kinds.kind_of(dtype)
    if kind in kinds.RANGED or kind == kinds.BOOLEAN:
        return f"CAST({value} AS DOUBLE)", T.DoubleType()
    return number_sql(text), T.DoubleType()


def normalize_sql(df: DataFrame, transforms: list[dict], source: str) -> str:
    """The normalize step as one SELECT, transforms nested in their order."""
    current = {f.name: (quoted(f.name), f.dataType) for f in df.schema.fields}
    for t in transforms:
        value, dtype = _transform_sql(t["op"], *current[t["column"]])
        if t["op"] == "to_numeric" and t.get("fill") is not None:
            value = f"coalesce({value}, CAST({float(t['fill'])!r} AS DOUBLE))"
        current[t["column"]] = (value, dtype)
    reads = [f"{value} AS {quoted(name)}" for name, (value, _) in current.items()]
    return f"SELECT {', '.join(reads)} FROM {quoted(source)}"


def select_sql(results) -> str:
    """All steps of a model as one query, each step a CTE."""
    if not results:
        raise ValueError("a model without steps has nothing to compile")
    unwritten = [r.id for r in results if r.compiled is None]
    if unwritten:
        raise ValueError(f"step(s) {', '.join(unwritten)} take several jobs and are no single statement")
    bodies = [f"{quoted(r.id)} AS (\n{r.compiled}\n)" for r in results]
    return "WITH " + ",\n".join(bodies) + f"\nSELECT * FROM {quoted(results[-1].id)}"


def create_sql(model: str, results, *, fmt: str = "parquet", location: str | None = None) -> str:
    place = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE {quoted(model)} USING {fmt}{place} AS\n{select_sql(results)}"


def register_inputs(spark: SparkSession, results) -> list[str]:
    """Views for the sources and models a compiled model reads by name."""
    own = {r.id for r in results}
    names = []
    for result in results:
        for table in result.inputs:
            if table.name not in own and table.name not in names:
                table.df.createOrReplaceTempView(quoted(table.name))
                names.append(table.name)
    return names


def compiled_frame(spark: SparkSession, results) -> DataFrame:
    """The compiled query run as SQL; equals the last step's frame."""
    names = register_inputs(spark, results)
    try:
        return spark.sql(select_sql(results))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
