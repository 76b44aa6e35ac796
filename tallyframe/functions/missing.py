"""Column lookup, with float NaN read as a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.FloatType, T.DoubleType)


def type_of(df: DataFrame, name: str) -> T.DataType:
    """Type of a column; an unknown name is an error that lists the known ones."""
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}; the table has {', '.join(df.columns)}")
    return df.schema[name].dataType


def col(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def raw(df: DataFrame, name: str) -> Column:
    type_of(df, name)
    return col(name)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL; other types are left untouched."""
    dtype = type_of(df, name)
    if isinstance(dtype, FLOATING):
        return F.nanvl(col(name), F.lit(None).cast(dtype))
    return col(name)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.StringType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column with NaN turned into NULL.

    The operators already do this for the columns they read, so this is for
    callers who go on with their own DataFrame code.
    """
    floats = {f.name: present(df, f.name) for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    return df.withColumns(floats) if floats else df
