"""Whole-number columns taken out of texts such as ``90 min``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.missing import raw
from tallyframe.functions.text import whole_number_with_unit


def unit_column(
    df: DataFrame,
    source: str,
    unit: str,
    suffixes: tuple[str, ...],
    out: str,
    when: Column | None = None,
) -> DataFrame:
    """Add ``out``: the number in ``source`` once ``suffixes`` are removed.

    Rows that ``when`` does not hold for, texts without ``unit`` and texts where
    something else is left over give NULL.
    """
    number = whole_number_with_unit(raw(df, source).cast("string"), unit, *suffixes)
    return df.withColumn(out, number if when is None else F.when(when, number))


def derive_durations(df: DataFrame, kind: str = "type", source: str = "duration") -> DataFrame:
    """Minutes of movies and seasons of shows; a table without these columns passes."""
    if kind not in df.columns or source not in df.columns:
        return df
    df = unit_column(df, source, "min", (" min",), "duration_minutes", raw(df, kind) == "Movie")
    return unit_column(
        df, source, "Season", (" Seasons", " Season"), "duration_seasons", raw(df, kind) == "TV Show"
    )
