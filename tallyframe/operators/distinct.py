"""Exact distinct counts of whole numbers by bitmap aggregates.

A value is a bit: ``bitmap_bucket_number`` names its bucket of 32,768 values and
``bitmap_bit_position`` its place there, for every ``bigint`` including 0 and negatives.
Tasks OR their bits into one bitmap per (group, bucket), 4 KB each whatever the number of
rows, Spark merges them by bucket, and the set bits are counted. Equal values meet in
the first task that sees them, so a value that fills a third of the table is one bit;
only (group, bucket, bitmap) rows are shuffled, never the values themselves.
``total_values`` takes this way where the values are dense (at least 512 a bucket on
average); ``group_agg``'s ``nunique`` keeps ``count(distinct)``, shuffled by key and value,
as bitmaps of sparse values would be larger than the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_whole(df: DataFrame, column: Column | str) -> bool:
    kind = df.select(column).schema.fields[0].dataType
    return isinstance(kind, WHOLE)


#: Values a bucket's bitmap (4 KB) must stand for on average to be smaller than the values (8 bytes each).
PER_BUCKET = 512


def dense(df: DataFrame, value: Column) -> bool:
    """Whether the whole numbers are dense enough for bitmaps: one aggregate of min, max and count.

    Sparse ones (random 64-bit ids, say) would cost a 4 KB bitmap a value; they are counted
    by ``count(distinct)`` instead.
    """
    low, high, n = df.agg(F.min(value).cast("decimal(21,0)"), F.max(value).cast("decimal(21,0)"), F.count(value)).first()
    if not n:
        return True
    buckets = int(high - low) // 32768 + 1
    return buckets * PER_BUCKET <= n


def bitmap_distinct(df: DataFrame, value: Column, keys: Sequence[Column] = (), name: str = "total_values") -> DataFrame:
    """Number of distinct non-null whole numbers of ``value``, per group of ``keys`` (the whole table without).

    A group whose values are all null counts 0; the whole table without rows counts 0.
    """
    rows = df.select(*keys, value.cast("long").alias("_tally_n"))
    names = [f.name for f in rows.schema.fields[: len(keys)]]
    bits = (
        rows.where(F.col("_tally_n").isNotNull())
        .groupBy(*names, F.bitmap_bucket_number("_tally_n").alias("_tally_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_tally_n")).alias("_tally_bits"))
    )
    counted = F.coalesce(F.sum(F.bitmap_count("_tally_bits")), F.lit(0)).cast("long").alias(name)
    if not names:
        return bits.agg(counted)
    present = rows.select(*names).distinct()
    return present.join(bits.groupBy(*names).agg(counted), names, "left").select(*names, F.coalesce(name, F.lit(0)).alias(name))
