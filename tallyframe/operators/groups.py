"""Aggregates per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.missing import col, is_text, present, type_of
from tallyframe.functions.places import file_place, wants_file_order
from tallyframe.functions.text import first_number
from tallyframe.operators.medians import median_by_sketches
from tallyframe.operators.rules import column_follows


def _skew(c: Column) -> Column:
    """Sample skewness, corrected for bias; needs three values."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(corrected))


NUMERIC = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c))),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "skew": _skew,
}
ANY_TYPE = {
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "nunique": F.count_distinct,
    "size": lambda c: F.count("*"),
}
TRUTH = {
    "any": lambda c: F.coalesce(F.bool_or(c), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c), F.lit(True)),
}
ORDERED = {"first": F.min_by, "last": F.max_by}
MEDIAN = ("median", "quantile")
FUNCTIONS = (*NUMERIC, *ANY_TYPE, *TRUTH, *ORDERED, *MEDIAN)


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def _as_number(dtype: T.DataType, c: Column) -> Column:
    return c.cast("bigint") if isinstance(dtype, T.BooleanType) else c


def _truth(dtype: T.DataType, c: Column) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c
    return c != F.lit("" if isinstance(dtype, T.StringType) else 0)


UNIT_FUNCTIONS = ("sum", "mean")
WHOLE_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def choose_units(df: DataFrame, column: str, funcs: Sequence[str], units: bool | str) -> bool:
    """Whether sums and means read the first number out of each text (at most one aggregate job)."""
    if not set(funcs) & set(UNIT_FUNCTIONS) or not is_text(df, column):
        return False
    return column_follows(df, column, "number_with_unit") if units == "auto" else bool(units)


def group_agg(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str | None = None,
    func: str | Sequence[str] = "count",
    units: bool | str = "auto",
    order_by: str | Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row per group of non-missing keys.

    A single key column is called ``key`` in the result, several keep their names.
    One function gives ``value``, as a double where it is a number; a list of
    functions gives ``<function>_value`` columns of their own types. ``units``
    settles whether sums and means of text use the first number in each text
    (``"auto"`` looks at the column, one aggregate job); all other functions of the list
    see the text. ``first`` and ``last`` need ``order_by``; ``order_by="file"`` is the
    order of the files read (path, then row). Exact medians come from KLL
    sketch bounds (``operators.medians``) and take a few checkpoints while the result is
    built; ``approximate`` lets ``median`` be an approximate percentile.
    """
    key_names = [keys] if isinstance(keys, str) else list(keys)
    column = column or key_names[0]
    funcs = [func] if isinstance(func, str) else list(func)
    unknown = [f for f in funcs if f not in FUNCTIONS]
    if unknown or not key_names or not funcs:
        raise ValueError(f"unknown aggregate {unknown}; known are {', '.join(FUNCTIONS)}")
    if len(key_names) > 1 and "value" in key_names:
        raise ValueError("one of several keys cannot be called value, which is the result")
    dtype = type_of(df, column)

    groups = ["key"] if len(key_names) == 1 else key_names
    value = present(df, column)
    with_units = UNIT_FUNCTIONS if choose_units(df, column, funcs, units) else ()
    types = {f: T.DoubleType() if f in with_units else dtype for f in funcs}
    needs_number = [f for f in funcs if (f in NUMERIC or f in MEDIAN) and not _is_number(types[f])]
    if needs_number:
        raise ValueError(f"{', '.join(needs_number)} of column {column!r} of type {dtype.simpleString()}")
    order = [order_by] if isinstance(order_by, str) else list(order_by or ())
    if not order and any(f in ORDERED for f in funcs):
        raise ValueError("first and last need order_by: rows have no order of their own")
    # order_by="file": the rows' places in their files (path, row index), where no column is so named.
    order_columns = file_place(df) if wants_file_order(df, order) else [present(df, o) for o in order]

    rows = df.select(
        *[present(df, k).alias(g) for k, g in zip(key_names, groups)],
        value.alias("_tally_value"),
        *[first_number(value).alias("_tally_number")] * bool(with_units),
        *[c.alias(f"_tally_order{i}") for i, c in enumerate(order_columns)],
    )
    for g in groups:
        rows = rows.where(col(g).isNotNull())

    names = ["value"] if isinstance(func, str) else [f"{f}_value" for f in funcs]
    medians = [n for f, n in zip(funcs, names) if f in MEDIAN and not approximate]
    source = {f: "_tally_number" if f in with_units else "_tally_value" for f in funcs}
    if isinstance(func, str) and func == "sum" and isinstance(dtype, T.LongType):
        # the result is a double; sums of decimal(20,0) are decimal(30,0) and do not overflow on the way
        rows, types = rows.withColumn("_tally_value", F.col("_tally_value").cast("decimal(20,0)")), {func: T.DecimalType(20, 0)}
    plain = [_aggregate(f, types[f], source[f], len(order_columns)).alias(n) for f, n in zip(funcs, names) if n not in medians]
    result = rows.groupBy(*[col(g) for g in groups]).agg(*plain) if plain else None
    if medians:
        numbers = rows.withColumn("_tally_value", _as_number(dtype, F.col("_tally_value")))
        exact = median_by_sketches(numbers, groups, "_tally_value", "_tally_median")
        exact = exact.select(*[col(g) for g in groups], *[F.col("_tally_median").alias(n) for n in medians])
        result = exact if result is None else result.join(exact, groups)
    result = result.select(*[col(c) for c in (*groups, *names)])
    if isinstance(func, str) and isinstance(result.schema["value"].dataType, T.NumericType):
        result = result.withColumn("value", F.col("value").cast("double"))
    return result


def _aggregate(func: str, dtype: T.DataType, source: str, n_order: int) -> Column:
    value = F.col(source)
    if func == "sum" and isinstance(dtype, WHOLE_TYPES):
        # as the single form: summed in decimals, which do not overflow, and given as a double
        return NUMERIC[func](_as_number(dtype, value).cast("decimal(20,0)")).cast("double")
    if func in NUMERIC:
        return NUMERIC[func](_as_number(dtype, value))
    if func in TRUTH:
        return TRUTH[func](_truth(dtype, value))
    if func in ORDERED:
        # one column as it is: a number or a time keeps the aggregate a hash aggregate
        columns = [F.col(f"_tally_order{i}") for i in range(n_order)]
        order = columns[0] if n_order == 1 else F.struct(*columns)
        return ORDERED[func](value, F.when(value.isNotNull(), order))
    if func in MEDIAN:
        return F.percentile_approx(_as_number(dtype, value), 0.5)
    return ANY_TYPE[func](value)


def order_groups(grouped: DataFrame) -> DataFrame:
    """Largest value first, missing values last, ties by key."""
    keys = [col(c) for c in grouped.columns if c != "value"]
    return grouped.orderBy(F.col("value").desc_nulls_last(), *keys)


def groups_count(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.agg(F.count_distinct(*[present(df, k) for k in names]).alias("groups_count"))
