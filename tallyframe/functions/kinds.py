"""Structural kinds of a column, and how two key columns are compared."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

INTEGER = "integer"
FLOAT = "float"
NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
STRING = "string"
OTHER = "other"

RANGED = frozenset({INTEGER, FLOAT, NUMERIC})

_INTEGRAL_BYTES = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
_TEMPORAL = tuple(
    getattr(T, name)
    for name in (
        "DateType",
        "TimestampType",
        "TimestampNTZType",
        "TimeType",
        "DayTimeIntervalType",
        "YearMonthIntervalType",
        "CalendarIntervalType",
    )
    if hasattr(T, name)
)


def kind_of(dtype: T.DataType) -> str:
    """The kind the rules see; they never look at a data type."""
    if type(dtype) in _INTEGRAL_BYTES:
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, _TEMPORAL):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return OTHER


def key_kind(dtype: T.DataType) -> str:
    """Kinds collapsed for joining: any number matches any number."""
    kind = kind_of(dtype)
    if kind in RANGED:
        return NUMERIC
    return kind if kind in (BOOLEAN, DATETIME) else STRING


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def as_text(column: Column, dtype: T.DataType) -> Column:
    """A value as text: JSON for nested types, base64 for bytes."""
    if isinstance(dtype, T.VariantType) or is_nested(dtype):
        return F.to_json(column)
    if isinstance(dtype, T.BinaryType):
        return F.base64(column)
    return column.cast("string")


def text_sql(expression: str, dtype: T.DataType) -> str:
    """:func:`as_text` as SQL text."""
    if isinstance(dtype, T.VariantType) or is_nested(dtype):
        return f"to_json({expression})"
    if isinstance(dtype, T.BinaryType):
        return f"base64({expression})"
    return f"CAST({expression} AS STRING)"


def common_key_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type two same-kind keys are compared in, or None to leave it to Spark."""
    if left == right:
        return left
    if type(left) in _INTEGRAL_BYTES and type(right) in _INTEGRAL_BYTES:
        return max((left, right), key=lambda t: _INTEGRAL_BYTES[type(t)])
    if kind_of(left) in RANGED and kind_of(right) in RANGED:
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (left, right)):
            return T.DoubleType()
        scale = max(_decimal(left)[1], _decimal(right)[1])
        whole = max(p - s for p, s in (_decimal(left), _decimal(right)))
        return T.DecimalType(min(38, whole + scale), scale)
    return None


def widens(source: T.DataType, target: T.DataType) -> bool:
    """Whether casting source to target keeps distinct values distinct."""
    if source == target:
        return True
    if type(source) in _INTEGRAL_BYTES and type(target) in _INTEGRAL_BYTES:
        return _INTEGRAL_BYTES[type(source)] <= _INTEGRAL_BYTES[type(target)]
    if isinstance(target, T.DoubleType):
        return isinstance(source, T.FloatType) or _INTEGRAL_BYTES.get(type(source), 8) <= 4
    if isinstance(target, T.DecimalType) and kind_of(source) in RANGED:
        p, s = _decimal(source)
        return p - s <= target.precision - target.scale and s <= target.scale
    return False


def _decimal(dtype: T.DataType) -> tuple[int, int]:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision, dtype.scale
    digits = {1: 3, 2: 5, 4: 10, 8: 20}
    return digits[_INTEGRAL_BYTES.get(type(dtype), 8)], 0
