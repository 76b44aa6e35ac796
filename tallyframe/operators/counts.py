"""Row counts, counts per value and numbers of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.missing import is_text, present
from tallyframe.functions.text import explode_list, text_form
from tallyframe.operators.distinct import bitmap_distinct, dense, is_whole
from tallyframe.operators.heavy import top_values
from tallyframe.operators.ranges import first_rows
from tallyframe.operators.rules import column_follows

DEFAULT_VALUES = 20
#: Limits up to which top values come from heavy-hitter summaries.
HEAVY_LIMIT = 1_000


def matching_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("matching_rows"))


def value_counts(
    df: DataFrame,
    column: str,
    limit: int | None = None,
    split: bool | str = "auto",
    name: str = "value",
) -> DataFrame:
    """Most frequent values of a column, ties in text order.

    ``split`` counts the items of comma-separated lists in place of whole texts;
    ``"auto"`` looks at the column first (one aggregate job, text columns only).
    Up to ``HEAVY_LIMIT`` values are found from Misra-Gries summaries and one exact
    count of the candidates (``operators.heavy``: a few small jobs); where these do not
    settle the answer, and for larger limits, all values are counted.
    """
    k = value_limit(limit)
    rows = value_rows(df, column, choose_split(df, column, split), name)
    counted = top_values(rows, name, k) if k <= HEAVY_LIMIT else None
    if counted is None:
        counted = rows.groupBy(name).agg(F.count("*").alias("count"))
    dtype = counted.schema[name].dataType
    counted = counted.select(text_form(F.col(name), dtype).alias(name), "count")
    return first_rows(counted, [(F.col("count"), False), (F.col(name), True)], k)


def value_limit(limit: int | None) -> int:
    if limit is not None and limit < 0:
        raise ValueError(f"negative limit {limit}")
    return limit or DEFAULT_VALUES


def choose_split(df: DataFrame, column: str, split: bool | str) -> bool:
    if split == "auto":
        return is_text(df, column) and column_follows(df, column, "comma_list")
    return bool(split)


def count_values(df: DataFrame, column: str, split: bool = False, name: str = "value") -> DataFrame:
    """All values with their counts, unordered.

    Equal values meet in the map-side aggregate, so a value that fills a third of
    the table still leaves each task as one row.
    """
    counted = value_rows(df, column, split, name).groupBy(name).agg(F.count("*").alias("count"))
    dtype = counted.schema[name].dataType
    return counted.select(text_form(F.col(name), dtype).alias(name), "count")


def value_rows(df: DataFrame, column: str, split: bool, name: str) -> DataFrame:
    """The column's values (or list items) that are present, as the one column ``name``."""
    value = present(df, column)
    if split:
        return explode_list(df, value.cast("string"), name)
    return df.select(value.alias(name)).where(F.col(name).isNotNull())


def total_values(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values of the whole column, lists left unsplit."""
    value = present(df, column)
    if not approximate and is_whole(df, value) and dense(df, value):
        return bitmap_distinct(df, value)
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(value).alias("total_values"))
