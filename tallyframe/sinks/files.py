"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per row; missing values are written as explicit nulls."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and every value in double quotes, inner quotes doubled."""
    df.write.mode(mode).options(header=True, quoteAll=True, quote='"', escape='"').csv(path)
