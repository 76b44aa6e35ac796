"""Columns in which every row has a value of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.functions.missing import present, type_of
from tallyframe.operators.metrics import MARGIN, ColumnMetrics, measure

# Values of these types are not wider than their hash.
NARROW = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Fixed: a single row does not make an identifier.
LEAST_ROWS = 2

SUSPECTS = 100


def id_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Names of the columns whose distinct count equals the row count.

    A sketch of every column rules out most of them in one pass; what remains is
    checked exactly, because an estimate cannot tell one repeated value in a billion.
    """
    rows, measured = measure(df, columns or df.columns)
    names = id_names(df, rows, measured)
    return [m.name for m in measured if m.name in names]


def id_names(df: DataFrame, rows: int, measured: Sequence[ColumnMetrics]) -> set[str]:
    """Columns without a repeated value, among those whose estimate allows it.

    All of them are looked at in one job by (column, hash); only a column in which some
    hash repeats is then compared by value.
    """
    likely = [m.name for m in measured if m.present == rows and m.distinct >= rows * (1 - MARGIN)]
    if rows < LEAST_ROWS or not likely:
        return set()
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.xxhash64(present(df, n)).alias("hash")) for i, n in enumerate(likely)])
    hashes = df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("column", "hash").count()
    doubtful = {likely[r["column"]] for r in hashes.where("count > 1").select("column").distinct().collect()}
    return {n for n in likely if n not in doubtful or not has_repeated_value(df, n)}


def has_repeated_value(df: DataFrame, column: str) -> bool:
    """Exact test for a value that occurs twice.

    Wide values are grouped by hash, so that eight bytes per row are shuffled and not
    whole texts. Rows that share a hash are then compared by value: first those of a
    few hashes, which settles it unless all of these are chance collisions, then all.
    """
    value = present(df, column)
    if isinstance(type_of(df, column), NARROW):
        return _repeated(df.select(value.alias("value")))
    hashed = df.select(value.alias("value"), F.xxhash64(value).alias("hash"))
    suspects = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    few = [r["hash"] for r in suspects.limit(SUSPECTS).collect()]
    if not few:
        return False
    if _repeated(hashed.where(F.col("hash").isin(few))):
        return True
    return len(few) == SUSPECTS and _repeated(hashed.join(suspects, "hash", "left_semi"))


def _repeated(values: DataFrame) -> bool:
    counted = values.groupBy("value").agg(F.count("*").alias("n"))
    return not counted.where("n > 1").isEmpty()
