"""Text rules: space trimming and what counts as a number written as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode space separators (category Zs).
SPACE_SEPARATORS = (
    "\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)


def strip_spaces(column: Column) -> Column:
    """Trim space separators only; tabs and line breaks stay."""
    return F.trim(column, F.lit(SPACE_SEPARATORS))


# The spellings of a number in text. Suffixed and hexadecimal forms
# (``12D``, ``0x1p3``), which Spark alone would read, are text here.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def parse_double(column: Column) -> Column:
    """Text to double, null where it is not a number.

    The pattern is tested first: a failed cast costs far more than a failed match.
    """
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def strip_sql(expression: str) -> str:
    """:func:`strip_spaces` as SQL text."""
    return f"trim(BOTH '{SPACE_SEPARATORS}' FROM {expression})"


def number_sql(expression: str) -> str:
    """:func:`parse_double` as SQL text."""
    return f"CASE WHEN {expression} RLIKE r'{NUMBER}' THEN try_cast({expression} AS DOUBLE) END"


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; null counts as not."""
    return F.count(F.when(condition, F.lit(1)))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0.0 where the whole is nothing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def flag_list(*pairs: tuple[str, Column]) -> Column:
    """Names whose condition holds, in the order given."""
    marks = [F.when(condition, F.lit(name)) for name, condition in pairs]
    empty = F.array().cast("array<string>")
    return F.array_compact(F.array(*marks)) if marks else empty
