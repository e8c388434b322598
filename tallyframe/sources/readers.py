"""Readers: Parquet with its own schema, CSV typed from all of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.functions.text import NUMBER
from tallyframe.operators.profile import positional, profile
from tallyframe.sources.files import stem_of, suffix_of

# The texts a CSV uses for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Candidate types, narrowest first: the pattern a text must have, and its type.
_TYPES = (
    (r"^\s*[+-]?\d+\s*$", "bigint"),
    (NUMBER, "double"),
    (r"(?i)^(true|false)$", "boolean"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "date"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$", "timestamp_ntz"),
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_text(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Every column as text, missing-value texts as null."""
    raw = spark.read.csv(
        path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    table = positional(raw)
    cells = [F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(n)
             for c, n in zip(table.columns, raw.columns)]
    return table.select(*cells)


# whole numbers that a number would not give back: leading zeros, too many digits
_CODE = r"^\s*[+-]?(0\d+|\d{16,})\s*$"


def _parsed(column: Column, pattern: str, dtype: str) -> Column:
    return F.when(column.rlike(pattern), column.try_cast(dtype))


def infer_types(text: DataFrame) -> dict[str, str]:
    """The narrowest type every non-null value of each column satisfies.

    One pass over all rows; a column without values stays text, and so does one with
    numbers that would lose digits: codes with leading zeros and very long integers.
    """
    cells = positional(text)
    cell = F.col("cell")
    code = cell.rlike(_CODE)
    counts = [F.count("cell").alias("present"),
              # an integer of up to 18 digits keeps all it says, unless zeros lead it
              F.count(F.when(code & (cell.rlike(r"^\s*[+-]?0") | (F.length(F.trim("cell")) > 18)), 1)).alias("codes")]
    counts += [F.count(_parsed(cell, pattern, dtype)).alias(f"t{j}") for j, (pattern, dtype) in enumerate(_TYPES)]
    # one row per cell, so that a wide table needs no more aggregates than a narrow one
    found = cells.select(F.posexplode(F.array(*cells.columns)).alias("at", "cell")).groupBy("at").agg(*counts).collect()
    types = dict.fromkeys(text.columns, "string")
    for row in found:
        fits = [t for j, (_, t) in enumerate(_TYPES) if row["present"] and row[f"t{j}"] == row["present"]
                and not (row["codes"] and t in ("bigint", "double"))]
        types[text.columns[row["at"]]] = fits[0] if fits else "string"
    return types


def read_csv(spark: SparkSession, path: str, *, types: dict | None = None,
             multi_line: bool = False) -> DataFrame:
    """A CSV with header, typed. Pass ``types`` from an earlier look to skip the pass."""
    text = read_csv_text(spark, path, multi_line=multi_line)
    types = types or infer_types(text)
    patterns = {dtype: pattern for pattern, dtype in _TYPES}
    table = positional(text)
    cells = []
    for c, name in zip(table.columns, text.columns):
        dtype = types.get(name, "string")
        column = F.col(c) if dtype == "string" else _parsed(F.col(c), patterns[dtype], dtype)
        cells.append(column.alias(name))
    return table.select(*cells)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read one source by its suffix, lazily."""
    reader = {".csv": read_csv, ".parquet": read_parquet}[suffix_of(path)]
    return reader(spark, path)


def load_named(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Several sources, each named for its file."""
    return {stem_of(path): load_table(spark, path) for path in paths}


def profile_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """Profile a file. A CSV is parsed once and held; Parquet is read by column."""
    df = load_table(spark, path)
    return profile(df, columnar=suffix_of(path) == ".parquet", **options)
