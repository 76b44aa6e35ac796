"""Equality between the text form of a column and the text form of a value.

The check is done once on the driver: if the value is written exactly as the
column type would print it, the column is compared with a typed literal, which the
scan can push down; if not, no row can be equal.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import numpy as np
from pyspark.sql import Column, functions as F, types as T

INTEGER_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
TIMESTAMP_TEXT = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{0,5}[1-9])?")


def _integer(text: str, dtype: T.DataType) -> int | None:
    if not re.fullmatch(r"-?\d+", text, re.ASCII) or str(int(text)) != text:
        return None
    half = 1 << (INTEGER_BITS[type(dtype)] - 1)
    return int(text) if -half <= int(text) < half else None


def _floating(text: str, dtype: T.DataType) -> float | None:
    try:
        number = float(text)
    except ValueError:
        return None
    shown = repr(number) if isinstance(dtype, T.DoubleType) else _float_text(np.float32(number))
    return number if shown == text and number == number else None


def _float_text(number: np.float32) -> str:
    """The shortest digits of a float, written out where a double would be."""
    if not np.isfinite(number):
        return str(number)
    if number == 0 or 1e-4 <= abs(number) < 1e16:
        return np.format_float_positional(number, unique=True, trim="0")
    return np.format_float_scientific(number, unique=True, trim="-", exp_digits=2)


def _decimal(text: str, dtype: T.DecimalType) -> Decimal | None:
    try:
        number = Decimal(text)
    except InvalidOperation:
        return None
    fits = number.is_finite() and -number.as_tuple().exponent == dtype.scale and f"{number:f}" == text
    return number if fits and number.adjusted() < dtype.precision - dtype.scale else None


def _calendar(text: str, dtype: T.DataType) -> str | None:
    try:
        if isinstance(dtype, T.DateType):
            return text if date.fromisoformat(text).isoformat() == text else None
        datetime.fromisoformat(text)
        return text if TIMESTAMP_TEXT.fullmatch(text) else None
    except ValueError:
        return None


def equals_text(column: Column, dtype: T.DataType, value: object) -> Column:
    text = str(value)
    if isinstance(dtype, T.StringType):
        return column == F.lit(text)
    if isinstance(dtype, T.BooleanType):
        literal = {"True": True, "False": False}.get(text)
    elif type(dtype) in INTEGER_BITS:
        literal = _integer(text, dtype)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        literal = _floating(text, dtype)
    elif isinstance(dtype, T.DecimalType):
        literal = _decimal(text, dtype)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        literal = _calendar(text, dtype)
    else:
        return column.cast("string") == F.lit(text)
    return F.lit(False) if literal is None else column == F.lit(literal).cast(dtype)
