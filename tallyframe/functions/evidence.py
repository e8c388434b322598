"""Rows as plain dicts, for specs, logs and tests. Rounding happens only here."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Row

PLACES = 4


def plain(value: Any) -> Any:
    """One value as JSON would hold it."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else plain(float(value))
    if isinstance(value, float):
        return round(value, PLACES) if math.isfinite(value) else None
    if isinstance(value, Row):
        return {name: plain(item) for name, item in value.asDict(recursive=False).items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(item) for item in value]
    if isinstance(value, (dt.date, dt.datetime, dt.time)):
        return value.isoformat()
    return str(value)
