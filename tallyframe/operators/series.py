"""The small labelled series behind a chart."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions.missing import col, present, type_of
from tallyframe.functions.text import INTEGER_TEXT, text_form
from tallyframe.operators.order import row_order
from tallyframe.operators.ranges import sort_columns, with_positions

# Fixed names and numbers.
YEAR_LIKE = ("release_year", "year", "date_added")
COMPOSITIONAL = ("type",)
YEARS = (1000, 2100)
LABELS_LOOKED_AT = 5
ALL_GROUPS_UP_TO = 20
TOP_GROUPS = 15

# A limit up to which a series is numbered in one task.
SMALL_SERIES = 1_000


def _series(rows: DataFrame, label: Column, value: Column) -> DataFrame:
    numeric = isinstance(rows.select(value.alias("v")).schema["v"].dataType, T.NumericType)
    return rows.select(label.cast("string").alias("label"), (value.cast("double") if numeric else value).alias("value"))


def _number(series: DataFrame, bounded: bool) -> DataFrame:
    """Add ``ordinal``, largest value first and ties by label.

    ``bounded`` says that a limit up to ``SMALL_SERIES`` holds. Other series are numbered
    by ranges, with one checkpoint; both give the same numbers.
    """
    order = [F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last()]
    if bounded:
        numbered = series.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        numbered = with_positions(series, order, "ordinal")
    return numbered.select("ordinal", "label", "value")


def count_series(counted: DataFrame, bounded: bool = False) -> DataFrame:
    """Series of a ``value_counts`` result; ``bounded`` if its limit is small."""
    return _number(_series(counted, F.col("value"), F.col("count")), bounded)


def breakdown_series(labelled: DataFrame) -> DataFrame:
    """Series of a breakdown, which may have any number of labels."""
    return _number(_series(labelled, F.col("label"), F.col("value")), bounded=False)


def group_series(grouped: DataFrame) -> DataFrame:
    """Series of a ``group_agg`` result: all groups up to 20, else the top 15.

    One top-k tells both cases apart, and the windows see at most 21 rows.
    """
    keys = [c for c in grouped.columns if c != "value"]
    label = F.concat_ws(", ", *[text_form(col(k), type_of(grouped, k)) for k in keys])
    rows = grouped.select(
        label.alias("label"), "value", F.struct(*[col(k) for k in keys]).alias("keys")
    )
    order = [F.col("value").desc_nulls_last(), F.col("keys")]
    top = rows.orderBy(*order).limit(ALL_GROUPS_UP_TO + 1)
    top = top.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))
    top = top.withColumn("n", F.count("*").over(Window.partitionBy()))
    kept = top.where((F.col("n") <= ALL_GROUPS_UP_TO) | (F.col("ordinal") <= TOP_GROUPS))
    return kept.select(F.col("ordinal").cast("bigint").alias("ordinal"), "label", "value")


def sort_series(sorted_rows: DataFrame, target: str, value: str, ascending: bool, bounded: bool = False) -> DataFrame:
    """``target`` against ``value`` in the order of a ``sort_limit`` result, ties included."""
    order = sort_columns(row_order(sorted_rows, [target], ascending))
    if bounded:
        numbered = sorted_rows.withColumn("_tally_ordinal", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        numbered = with_positions(sorted_rows, order, "_tally_ordinal")
    numeric = isinstance(type_of(sorted_rows, value), T.NumericType)
    shown = present(sorted_rows, value)
    return numbered.select(
        F.col("_tally_ordinal").alias("ordinal"),
        text_form(present(sorted_rows, target), type_of(sorted_rows, target)).alias("label"),
        (shown.cast("double") if numeric else shown).alias("value"),
    )


def first_labels(rows: DataFrame, target: str, ascending: bool) -> DataFrame:
    """First distinct labels of rows sorted by ``target``, as ``label``."""
    distinct = rows.select(present(rows, target).alias("key")).distinct()
    order = F.col("key").asc_nulls_last() if ascending else F.col("key").desc_nulls_last()
    return distinct.orderBy(order).limit(LABELS_LOOKED_AT).select(
        text_form(F.col("key"), type_of(rows, target)).alias("label")
    )


def with_share(series: DataFrame, bounded: bool = False) -> DataFrame:
    """Add ``pct``, the share of the total of the rows shown, to one decimal.

    The total is an aggregate of its own; where a small limit holds (``bounded``) it is
    taken from the rows themselves, so that these are worked out once.
    """
    total = F.sum("value").over(Window.partitionBy()) if bounded else series.agg(F.sum("value").alias("total")).scalar()
    return series.withColumn("pct", F.round(F.lit(100.0) * F.col("value") / total, 1))


def looks_like_years(label: Column) -> Column:
    """Aggregate: is every label (empty ones aside) a whole number like a year?"""
    year = F.when(label.rlike(INTEGER_TEXT), F.abs(label.try_cast("bigint"))).between(*YEARS)
    tested = F.when(F.coalesce(label != "", F.lit(True)), F.coalesce(year, F.lit(False)))
    return F.coalesce(F.bool_and(tested), F.lit(True))


def chart_kind(
    series: DataFrame,
    target: str | None,
    choice: str | None = None,
    year_like: Iterable[str] = YEAR_LIKE,
    compositional: Sequence[str] = COMPOSITIONAL,
) -> DataFrame:
    """``kind`` of chart in one row; an explicit choice other than ``auto`` wins."""
    otherwise = F.lit("pie" if target in tuple(compositional) else "bar")
    if choice and choice != "auto":
        kind = F.lit(choice)
    elif target in tuple(year_like):
        kind = F.lit("line")
    else:
        kind = F.when(F.col("years"), F.lit("line")).otherwise(otherwise)
    head = series.where(F.col("ordinal") <= LABELS_LOOKED_AT)
    return head.agg(looks_like_years(F.col("label")).alias("years")).select(kind.alias("kind"))
