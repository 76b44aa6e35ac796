"""Structural rules about a column, each a share of its values.

A rule is written once, on two whole numbers (values looked at, values that
conform), and serves both as a column expression and on collected counts. Shares are
compared in whole numbers, so a share exactly on a threshold is never misjudged.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.missing import is_text, present, raw
from tallyframe.functions.dates import candidate_formats, date_shape, parse_counts
from tallyframe.functions.text import is_float_text, is_number_with_unit


@dataclass(frozen=True)
class Rule:
    """``hits`` gives aggregates; the largest of them is the number that conform.

    For dates it counts the values that have the form of one. Those that are one are
    counted by `date_hits`.
    """

    hits: Callable[[Column], list[Column]]
    holds: Callable


# Fixed thresholds: least number of values, then share of those that conform.
TEXT_RULES = {
    "comma_list": Rule(
        lambda c: [F.count_if(c.contains(","))],
        lambda n, hits: (n >= 5) & (hits * 5 > n),
    ),
    "number_with_unit": Rule(
        lambda c: [F.count_if(is_number_with_unit(c))],
        lambda n, hits: (n >= 5) & (hits * 2 > n),
    ),
    "date_text": Rule(
        lambda c: [F.count(date_shape(c))],
        lambda n, hits: (n >= 3) & (hits * 5 > n * 3),
    ),
    "mixed_numeric": Rule(
        lambda c: [F.count_if(is_float_text(c))],
        lambda n, hits: (n >= 5) & (hits * 2 >= n) & (hits * 100 < n * 99),
    ),
}


def missing_rate_is_high(rows, missing):
    return missing * 5 > rows * 2


def date_hits(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """For each text column, how many of its values the best date format parses.

    Two jobs for all columns: the forms that occur, then the formats that have them.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), date_shape(raw(df, c)).alias("shape")) for c in columns])
    seen = df.select(F.explode(cells).alias("cell")).select("cell.*").where("shape is not null")
    shapes: dict[str, list[str]] = {}
    for r in seen.groupBy("column", "shape").count().collect():
        shapes.setdefault(r["column"], []).append(r["shape"])
    counts = {c: parse_counts(raw(df, c), candidate_formats(found)) for c, found in shapes.items()}
    flat = [(c, count) for c, many in counts.items() for count in many]
    if not flat:
        return dict.fromkeys(columns, 0)
    hits = df.agg(*[count.alias(f"h{i}") for i, (_, count) in enumerate(flat)]).first()
    best = dict.fromkeys(columns, 0)
    for (column, _), n in zip(flat, hits):
        best[column] = max(best[column], n)
    return best


def rule_check(df: DataFrame, column: str, rule: str) -> Column:
    """Aggregate expression: does the column follow a text rule?"""
    if not is_text(df, column):
        return F.lit(False)
    text = raw(df, column)
    hits = TEXT_RULES[rule].hits(text)
    if rule == "date_text":
        shapes = df.select(date_shape(text).alias("shape")).where("shape is not null").groupBy("shape").count().collect()
        hits = parse_counts(text, candidate_formats(r["shape"] for r in shapes)) or [F.lit(0)]
    return TEXT_RULES[rule].holds(F.count(text), hits[0] if len(hits) == 1 else F.greatest(*hits))


def missing_check(df: DataFrame, column: str) -> Column:
    """Aggregate expression: is too much of the column missing?"""
    return missing_rate_is_high(F.count("*"), F.count("*") - F.count(present(df, column)))


def column_follows(df: DataFrame, column: str, rule: str) -> bool:
    """Run the check, to settle the form of a query that depends on the data."""
    return df.agg(rule_check(df, column, rule).alias("holds")).first()["holds"]
