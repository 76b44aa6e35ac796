"""Sorting, limits and samples of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.missing import present
from tallyframe.functions.places import file_place, wants_file_order
from tallyframe.operators.ranges import first_rows

DEFAULT_ROWS = 5


def sort_limit(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    ascending: bool = False,
    limit: int | None = DEFAULT_ROWS,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """First rows by one or more columns, missing values last in both directions.

    ``columns`` defaults to the first column and ``None`` as limit keeps all rows.
    Ties follow ``tie_break``, which defaults to all other columns that can be ordered,
    from left to right, so that the rows kept do not depend on how they were found.
    """
    if limit is not None and limit < 0:
        raise ValueError(f"negative limit {limit}")
    names = [columns] if isinstance(columns, str) else list(columns or df.columns[:1])
    return first_rows(df, row_order(df, names, ascending, tie_break), limit)


def row_order(
    df: DataFrame, names: Sequence[str], ascending: bool, tie_break: Sequence[str] | None = None
) -> list[tuple[Column, bool]]:
    """Columns with their directions that put the rows of a table in one order."""
    ties = [f.name for f in df.schema.fields if can_be_ordered(f.dataType)] if tie_break is None else tie_break
    order = [(present(df, n), ascending) for n in names]
    return order + [(present(df, t), True) for t in ties if t not in names]


def can_be_ordered(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return can_be_ordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(can_be_ordered(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """Any ``n`` rows, or the first ``n`` in a given order; ``["file"]`` is the order of the files read."""
    if n < 0:
        raise ValueError(f"negative limit {n}")
    if not order_by:
        return df.limit(n)
    if wants_file_order(df, list(order_by)):
        place = file_place(df)
        named = df.select("*", *[c.alias(f"_tally_place{i}") for i, c in enumerate(place)])
        kept = first_rows(named, [(F.col(f"_tally_place{i}"), True) for i in range(len(place))], n)
        return kept.drop(*[f"_tally_place{i}" for i in range(len(place))])
    return first_rows(df, [(present(df, o), True) for o in order_by], n)
