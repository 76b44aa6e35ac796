"""Row conditions: text search, equality of text forms, and calendar parts."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.dates import formats_found, parse_any
from tallyframe.functions.literals import equals_text
from tallyframe.functions.missing import is_text, raw, type_of
from tallyframe.functions.text import text_form

CALENDAR = (T.DateType, T.TimestampType, T.TimestampNTZType)
REGEX_SIGNS = frozenset(".^$*+?{}[]\\|()")

# Letters whose case-insensitive matches outside ASCII are not found by lower().
SPECIAL_CASE_LETTERS = frozenset("isIS")


def contains(df: DataFrame, column: str, value: object) -> Column:
    """Case-insensitive regular-expression search in the text form of a column."""
    return search(text_form(raw(df, column), type_of(df, column)), str(value))


def search(text: Column, pattern: str) -> Column:
    """``pattern`` found anywhere in ``text``.

    A plain ASCII word is looked up as a substring of the lower-cased text, which is
    much cheaper than a regular expression. The few letters that have a case partner
    beyond ASCII need the expression, but only in texts that are not pure ASCII.
    """
    regex = text.rlike(java_pattern(pattern))
    if not pattern.isascii() or REGEX_SIGNS & set(pattern):
        return regex
    plain = F.lower(text).contains(pattern.lower())
    if SPECIAL_CASE_LETTERS & set(pattern):
        ascii_only = F.octet_length(text) == F.length(text)
        return text.isNotNull() & F.when(ascii_only, plain).otherwise(regex)
    return plain


def java_pattern(pattern: str) -> str:
    """The pattern with named groups in Java's spelling and Unicode case folding.

    ``d`` keeps ``.``, ``^`` and ``$`` to line feeds only; ``U`` makes ``\\w`` and its
    kin cover Unicode, and is only set where one occurs. A pattern that is wrong in
    Python is an error here, on the driver.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
    except re.error as error:
        raise ValueError(f"not a regular expression: {pattern!r}: {error}") from None
    names = {name: f"g{i}" for i, name in enumerate(dict.fromkeys(re.findall(r"\(\?P<(\w+)>", pattern)))}
    body = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{names[m[1]]}>", pattern)
    body = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{names.get(m[1], m[1])}>", body)
    return ("(?iudU)" if "\\" in pattern else "(?iud)") + _translated(body)


def _translated(pattern: str) -> str:
    """What both languages write alike but mean differently, in Java's words.

    ``\\s`` takes in the separators, ``\\Z`` is the very end, ``{,n}`` begins at zero, and
    ``[`` and ``&&`` are plain characters inside a class.
    """
    parts: list[str] = []
    inside, opened = False, 0
    for part in re.findall(r"\\.|\{,[0-9]+\}|&&|.", pattern, re.DOTALL):
        if inside:
            if part == "]" and len(parts) > opened and parts[opened:] != ["^"]:
                inside = False
            elif part in ("[", "]", "&&"):
                part = re.sub(r"(.)", r"\\\1", part)
            elif part == r"\s":
                part = r"\s\x1c-\x1f"
            elif part.startswith("{,"):
                part = part.replace("{", r"\{").replace("}", r"\}")
        elif part == "[":
            inside, opened = True, len(parts) + 1
        elif part == r"\s":
            part = r"[\s\x1c-\x1f]"
        elif part == r"\S":
            part = r"[^\s\x1c-\x1f]"
        elif part == r"\Z":
            part = r"\z"
        elif part.startswith("{,"):
            part = "{0," + part[2:]
        parts.append(part)
    return "".join(parts)


def equals(df: DataFrame, column: str, value: object) -> Column:
    return equals_text(raw(df, column), type_of(df, column), value)


def _whole(value: object, what: str) -> int:
    if isinstance(value, bool) or not re.fullmatch(r"\s*[+-]?\d+\s*", str(value)):
        raise ValueError(f"{what} must be a whole number, not {value!r}")
    return int(str(value))


def _date_text(df: DataFrame, column: str, formats: Sequence[str] | str | None) -> Column:
    """Timestamp of a text column, in the given formats or in those that occur.

    A column with values of which none has a known form is an error, not an empty answer.
    """
    if not is_text(df, column):
        kind = type_of(df, column).simpleString()
        raise ValueError(f"date filter on column {column!r} of type {kind}")
    text = raw(df, column)
    if formats is None or formats == "any":
        found = formats_found(df, text)
        if not found and not df.where(text.isNotNull()).isEmpty():
            raise ValueError(f"no known form of date in column {column!r}; name the Spark patterns in formats=")
        chosen = [fmt for fmt, _ in found] if formats == "any" else [max(found, key=lambda f: f[1])[0]] if found else []
    else:
        chosen = [formats] if isinstance(formats, str) else list(formats)
    return parse_any(text, chosen)


def _within(df: DataFrame, column: str, first: date, after: date) -> Column:
    """Half-open range on a typed column, so that the scan can skip row groups."""
    dtype, c = type_of(df, column), raw(df, column)
    low, high = (F.lit(d.isoformat()).cast(dtype) for d in (first, after))
    return (c >= low) & (c < high)


def in_year(df: DataFrame, column: str, value: object, formats=None, day: Column | None = None) -> Column:
    year = _whole(value, "year")
    if isinstance(type_of(df, column), CALENDAR):
        if not 1 <= year < 9999:
            return F.year(raw(df, column)) == year
        return _within(df, column, date(year, 1, 1), date(year + 1, 1, 1))
    return F.year(_date_text(df, column, formats) if day is None else day) == year


def in_month(df: DataFrame, column: str, value: object, formats=None, day: Column | None = None) -> Column:
    month = _whole(value, "month")
    if isinstance(type_of(df, column), CALENDAR):
        return F.month(raw(df, column)) == month
    return F.month(_date_text(df, column, formats) if day is None else day) == month


def in_month_of_year(df: DataFrame, column: str, value: object, formats=None, day: Column | None = None) -> Column:
    month, year = _month_and_year(value)
    if isinstance(type_of(df, column), CALENDAR):
        if 1 <= month <= 12 and 1 <= year < 9999:
            after = date(year + month // 12, month % 12 + 1, 1)
            return _within(df, column, date(year, month, 1), after)
        day = raw(df, column)
    elif day is None:
        day = _date_text(df, column, formats)
    return (F.month(day) == month) & (F.year(day) == year)


def _check_value(operator: str, value: object) -> None:
    if operator == "date_month_year":
        _month_and_year(value)
    else:
        _whole(value, operator.removeprefix("date_"))


def _month_and_year(value: object) -> tuple[int, int]:
    if not isinstance(value, Mapping) or not {"month", "year"} <= set(value):
        raise ValueError(f"value must hold month and year, not {value!r}")
    return _whole(value["month"], "month"), _whole(value["year"], "year")


PLAIN = {"contains": contains, "eq": equals}
DATED = {"date_month_year": in_month_of_year, "date_year": in_year, "date_month": in_month}


def apply_filters(
    df: DataFrame,
    filters: Sequence[Mapping] | Mapping | None,
    formats: Sequence[str] | str | None = None,
) -> DataFrame:
    """Rows for which all conditions hold.

    Each condition is ``{"column", "operator", "value"}``; the operator defaults to
    ``contains``. ``formats`` are the Spark patterns for date conditions on text
    columns, ``"any"`` to read each value in the first known one that fits it. Left
    out, the one format that reads most of the rows kept by the conditions before it
    is used. Both of these take two aggregate jobs for each such column, shared by all
    conditions on it; a column with values but without any known date is an error.
    """
    if not filters:
        return df
    kept, dates = df, {}
    for item in [filters] if isinstance(filters, Mapping) else filters:
        if "column" not in item or "value" not in item:
            raise ValueError(f"a filter needs column and value: {item!r}")
        operator = item.get("operator", "contains")
        if operator in PLAIN:
            condition = PLAIN[operator](kept, item["column"], item["value"])
        elif operator in DATED:
            column = item["column"]
            _check_value(operator, item["value"])
            if formats in (None, "any") and is_text(kept, column) and column not in dates:
                dates[column] = _date_text(kept, column, formats)
            condition = DATED[operator](kept, column, item["value"], formats, dates.get(column))
        else:
            raise ValueError(f"unknown filter operator {operator!r}")
        kept = kept.filter(condition)
    return kept
