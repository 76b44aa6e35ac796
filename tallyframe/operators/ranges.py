"""Exact positions in a sorted table without a single-task window.

Rows are range-partitioned on the sort columns, sorted inside their range, and
checkpointed with the number of the range and their place in it. A count per range then
gives the position at which each range starts. A range is a share of the table whatever
the keys, so one hot key is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.missing import col
from tallyframe.shared import cut_lineage

RANGE, PLACE = "_tally_range", "_tally_place"

# Up to this many first rows are gathered in one task. Every task of the scan sends as
# many to it, so the number stays small.
SMALL_LIMIT = 1_000

# Sampled rows that a large limit should hold.
SAMPLE_HITS = 10_000

# The row number within a task, in the lower bits of Spark's increasing ids.
ROW_BITS = (1 << 33) - 1


def number_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range and their place in it, fixed by a checkpoint.

    The number of the row in the scan is the last sort column: rows that are equal in
    all others can then lie in several ranges, so that no value, however frequent,
    makes a range larger than the rest, and the order is one and the same throughout.
    """
    split = df.withColumn("_tally_split", F.monotonically_increasing_id())
    ranged = split.repartitionByRange(*order, "_tally_split").sortWithinPartitions(*order, "_tally_split")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    return cut_lineage(ranged.drop("_tally_split").select("*", F.spark_partition_id().alias(RANGE), place.alias(PLACE)))


def with_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row in ``order``: one shuffle and one checkpoint.

    The window sees one row per range, of which there are at most as many as shuffle
    partitions; they are broadcast, and no row is moved again.
    """
    ranged = number_ranges(df, order)
    starts = ranged.groupBy(RANGE).agg(F.count("*").alias("_tally_size"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(RANGE, F.coalesce(F.sum("_tally_size").over(earlier), F.lit(0)).alias("_tally_start"))
    return (
        ranged.join(F.broadcast(starts), RANGE)
        .withColumn(name, F.col("_tally_start") + F.col(PLACE) + 1)
        .drop(RANGE, PLACE, "_tally_start")
    )


def sort_columns(order: Sequence[tuple[Column, bool]]) -> list[Column]:
    """Sort columns from (column, ascending) pairs, missing values always last."""
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last() for c, ascending in order]


def first_rows(df: DataFrame, order: Sequence[tuple[Column, bool]], limit: int | None) -> DataFrame:
    """Rows in order, cut at ``limit``; the same rows whatever the way to them.

    A small limit is a top-k in every task and one merge. Beyond that the merge
    would hold the whole result, so rows are taken by their position, among those
    that can be in the result at all. That takes three jobs while the result is built:
    a sample, a count of the rows it leaves, and a checkpoint.
    """
    columns = sort_columns(order)
    if limit is None:
        return df.orderBy(*columns)
    if limit <= SMALL_LIMIT:
        return df.orderBy(*columns).limit(limit)
    placed = with_positions(_candidates(df, order[0], limit), columns, "_tally_position")
    return placed.where(F.col("_tally_position") <= limit).orderBy("_tally_position").drop("_tally_position")


def _candidates(df: DataFrame, first: tuple[Column, bool], limit: int) -> DataFrame:
    """Rows up to a bound on the first sort column that at least ``limit`` rows meet.

    A sample proposes the bound, placed to leave twice the rows needed, and a count of
    the rows that meet it confirms it. Without a confirmed bound all rows stay.
    """
    key, ascending = first
    sampled = df.select(key.alias("key")).sample(min(1.0, SAMPLE_HITS / limit), seed=1)
    top = sampled.orderBy(*sort_columns([(F.col("key"), ascending)])).limit(2 * SAMPLE_HITS)
    last = F.max("key") if ascending else F.min("key")
    n, present, bound = top.agg(F.count("*"), F.count("key"), last).first()
    if n < 2 * SAMPLE_HITS or present < n:
        return df
    kept = df.where(key <= F.lit(bound) if ascending else key >= F.lit(bound))
    return kept if kept.count() >= limit else df


def median_by_ranges(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of ``value`` per key group, whatever the size of a group.

    Equal values of a group are merged into one weighted row first; one checkpoint of
    these serves for the sizes and for the values. The ranges that hold the middle one or
    two of a group (at most two of them) are found from the counts per range, and only
    those are ordered. A group without values has the median NULL.
    """
    names = [*keys, value]
    columns = [col(n) for n in names]
    weighted = df.groupBy(*columns).agg(F.count(col(value)).alias("_tally_weight"))
    ranged = number_ranges(weighted, columns)

    group = Window.partitionBy(*[col(k) for k in keys])
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*[col(k) for k in keys], RANGE).agg(F.sum("_tally_weight").alias("_tally_size"))
    sizes = sizes.withColumn("_tally_total", F.sum("_tally_size").over(group)).withColumn(
        "_tally_before", F.coalesce(F.sum("_tally_size").over(before), F.lit(0))
    )
    low, high = F.expr("(_tally_total + 1) div 2"), F.expr("_tally_total div 2 + 1")
    middle = sizes.where((F.col("_tally_before") < high) & (F.col("_tally_before") + F.col("_tally_size") >= low))

    inside = Window.partitionBy(*[col(k) for k in keys], RANGE).orderBy(col(value))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = ranged.join(middle, [*keys, RANGE]).withColumn(
        "_tally_until", F.col("_tally_before") + F.sum("_tally_weight").over(inside)
    )
    picked = picked.where((F.col("_tally_until") - F.col("_tally_weight") < high) & (F.col("_tally_until") >= low))
    halves = F.min(col(value)).cast("double") * 0.5 + F.max(col(value)).cast("double") * 0.5
    medians = picked.groupBy(*[col(k) for k in keys]).agg(halves.alias(out))
    empty = sizes.where("_tally_total = 0").select(*[col(k) for k in keys], F.lit(None).cast("double").alias(out))
    return medians.unionByName(empty.distinct())
