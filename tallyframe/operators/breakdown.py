"""The column that best splits a set of rows into a handful of classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.missing import present
from tallyframe.operators.counts import count_values
from tallyframe.operators.ids import id_names
from tallyframe.operators.metrics import MARGIN, ColumnMetrics, measure

# Fixed names: long free texts, and texts with very many values.
FREE_TEXT = ("title", "description", "cast", "director")
MANY_VALUES = ("duration", "date_added")
EXCLUDED = FREE_TEXT + MANY_VALUES

# The number of classes that makes the best chart.
IDEAL = 4


def pick_breakdown_column(df: DataFrame, exclude: Iterable[str] = EXCLUDED) -> str | None:
    """Column whose distinct count is nearest to four; the first one on a tie.

    Excluded names, id columns and columns of one value are left out. Sketches give
    bounds for every column in one pass; only columns that could still be nearest
    are counted exactly.
    """
    skipped = set(exclude)
    rows, measured = measure(df, [c for c in df.columns if c not in skipped])
    usable = [m for m in measured if m.distinct]
    open_columns = _could_be_nearest(usable)
    while ids := id_names(df, rows, open_columns):
        usable = [m for m in usable if m.name not in ids]
        open_columns = _could_be_nearest(usable)
    if not open_columns:
        return None
    exact = _distinct_counts(df, [m.name for m in open_columns])
    ranked = [(abs(n - IDEAL), i) for i, n in enumerate(exact) if n > 1]
    return open_columns[min(ranked)[1]].name if ranked else None


def _bounds(m: ColumnMetrics) -> tuple[float, float]:
    slack = m.distinct * MARGIN + 1
    return m.distinct - slack, m.distinct + slack


def _nearest(m: ColumnMetrics) -> float:
    low, high = _bounds(m)
    return max(low - IDEAL, IDEAL - high, 0.0)


def _furthest(m: ColumnMetrics) -> float:
    low, high = _bounds(m)
    return max(abs(low - IDEAL), abs(high - IDEAL))


def _could_be_nearest(measured: list[ColumnMetrics]) -> list[ColumnMetrics]:
    """Columns not certainly beaten by one that surely has two values or more."""
    sure = [_furthest(m) for m in measured if _bounds(m)[0] > 1]
    reach = min(sure, default=float("inf"))
    return [m for m in measured if _nearest(m) <= reach]


def _distinct_counts(df: DataFrame, columns: list[str]) -> list[int]:
    """Exact distinct counts of all columns by one hash aggregate over (column, value) cells.

    Values are compared by their text, which is one to one for every type that is not a
    container; maps are never open here.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("column"), F.to_json(F.struct(present(df, c).alias("v"))).alias("value"), present(df, c).isNotNull().alias("there")) for i, c in enumerate(columns)]
    )
    seen = df.select(F.explode(cells).alias("cell")).select("cell.*").where("there").select("column", "value").distinct()
    found = {r["column"]: r["count"] for r in seen.groupBy("column").count().collect()}
    return [found.get(i, 0) for i in range(len(columns))]


def breakdown(df: DataFrame, column: str | None = None, exclude: Iterable[str] = EXCLUDED) -> DataFrame:
    """``label, value`` of the breakdown column; empty if no column qualifies."""
    chosen = column or pick_breakdown_column(df, exclude)
    if chosen is None:
        return df.sparkSession.createDataFrame([], "label string, value bigint")
    return count_values(df, chosen, name="label").withColumnRenamed("count", "value")
