"""Per-column measurements in one pass, small enough for the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.missing import is_text, present, raw, type_of
from tallyframe.operators.rules import TEXT_RULES

# Tasks of the scan are merged in this many groups first, so that the last task gets
# this many sketches per column and not one per scanned split.
MERGE_GROUPS = 256

# Columns measured per pass over the rows. An aggregate with sketches stays a hash
# aggregate up to 128 keys.
COLUMNS_PER_PASS = 100

# log2 of the registers of a distinct sketch: a standard error of 1.6 percent.
SKETCH_BITS = 12

# Estimates are trusted to this relative error (six standard errors) in choosing
# which columns to count exactly.
MARGIN = 0.1


@dataclass
class ColumnMetrics:
    """``distinct`` is an estimate, 0 for types that cannot be compared."""

    name: str
    present: int
    distinct: int
    hits: dict[str, int] = field(default_factory=dict)


def measure(
    df: DataFrame, columns: Sequence[str], rules: Sequence[str] = ()
) -> tuple[int, list[ColumnMetrics]]:
    """Number of rows, and per column the present values, the rule hits and an
    estimate of the distinct values."""
    passes = [
        _partial(df, range(first, min(first + COLUMNS_PER_PASS, len(columns))), columns, rules)
        for first in range(0, len(columns), COLUMNS_PER_PASS)
    ]
    if not passes:
        return df.count(), []
    partial = reduce(DataFrame.unionAll, passes)
    merged = partial.groupBy("column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
        *[F.sum(n).alias(n) for n in partial.columns if n not in ("group", "column", "sketch")],
    )
    found = {r["column"]: r.asDict() for r in merged.collect()}
    empty = dict.fromkeys(merged.columns, 0)
    measured = []
    for i, name in enumerate(columns):
        counts = found.get(i, empty)
        hits = {
            rule: max(v for n, v in counts.items() if n.startswith(f"{rule} "))
            for rule in (rules if is_text(df, name) else ())
        }
        measured.append(ColumnMetrics(name, counts["present"], counts["distinct"] or 0, hits))
    return found.get(0, empty)["rows"], measured


def _partial(df: DataFrame, numbers: range, columns: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """Measurements per group of tasks and column.

    Each row becomes one cell per column (its text, and its hash for the sketch), so
    that the rules are stated once and the size of the query does not grow with the
    width of the table. Cells are aggregated in the task that makes them.
    """
    cells = df.select(F.explode(F.array(*[_cell(df, i, columns[i]) for i in numbers])).alias("cell"))
    cells = cells.select("cell.*")
    hits = {
        f"{rule} {j}": count for rule in rules for j, count in enumerate(TEXT_RULES[rule].hits(F.col("text")))
    }
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("group")
    return cells.groupBy(group, "column").agg(
        F.count("*").alias("rows"),
        F.count_if("present").alias("present"),
        F.hll_sketch_agg("hash", SKETCH_BITS).alias("sketch"),
        *[count.alias(name) for name, count in hits.items()],
    )


def _cell(df: DataFrame, number: int, name: str) -> Column:
    dtype, value = type_of(df, name), present(df, name)
    hashed = F.lit(None).cast("bigint")
    if not isinstance(dtype, (T.MapType, T.VariantType)):
        hashed = F.when(value.isNotNull(), F.xxhash64(value))
    text = raw(df, name) if is_text(df, name) else F.lit(None).cast("string")
    return F.struct(
        F.lit(number).alias("column"),
        value.isNotNull().alias("present"),
        hashed.alias("hash"),
        text.alias("text"),
    )
