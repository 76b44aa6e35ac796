"""Most frequent values from Misra-Gries summaries, settled by one exact count of candidates.

1. Every task keeps at most ``counters`` counters of its rows (Arrow counts each batch;
   when more values are held, the ``counters + 1``-th largest count is taken from all
   and the smaller ones are dropped). A counter never exceeds its value's count in the
   task, and falls short of it by at most the task's total of subtractions, ``e``.
2. Spark sums the counters by value (``lb``, a lower bound) and the tasks' ``e`` (``E``).
   A value's count is at most ``lb + E``; one that no summary holds has at most ``E``.
3. With ``L``, the ``k``-th largest ``lb``, only values with ``lb + E >= L`` can be among
   the first ``k``. They are counted exactly by a semi-join of the rows with them
   (broadcast up to ``broadcast_candidates``, counted; else shuffled).
4. The answer is settled if ``E`` is 0 (every value was counted) or there are ``k``
   candidates and the ``k``-th exact count exceeds ``E``: no other value can reach it,
   ties included. Otherwise the full count of all values decides, as before.

So a skewed column never shuffles all its distinct values, and a column of mostly
distinct values falls back to the full count, with the same rows either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Counters a task keeps; candidates whose names are broadcast at most.
COUNTERS, BROADCAST_CANDIDATES = 1 << 14, 1 << 18


def summaries(counters: int):
    """Misra-Gries summary of a task's values: rows (value, count, 0), then one row (null, 0, e)."""

    def run(batches):
        held, lost = None, 0
        for batch in batches:
            values = pc.drop_null(batch.column(0))
            if not len(values):
                continue
            counted = pc.value_counts(values)
            part = pa.table({"v": counted.field("values"), "c": counted.field("counts")})
            if held is not None:
                merged = pa.concat_tables([held, part]).group_by("v").aggregate([("c", "sum")])
                part = pa.table({"v": merged.column("v"), "c": merged.column("c_sum")})
            if part.num_rows > counters:
                counts = part.column("c").to_numpy()
                cut = int(np.partition(counts, -(counters + 1))[-(counters + 1)])
                left = counts - cut
                keep = left > 0
                part = pa.table({"v": part.column("v").filter(pa.array(keep)), "c": pa.array(left[keep])})
                lost += cut
            held = part
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays(
                [held.column("v").combine_chunks(), held.column("c").combine_chunks().cast(pa.int64()), pa.array(np.zeros(held.num_rows, np.int64))],
                names=["v", "c", "e"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, type=batch_type[0]) if batch_type else pa.nulls(1), pa.array([0], pa.int64()), pa.array([lost], pa.int64())],
            names=["v", "c", "e"],
        )

    batch_type: list = []
    return run, batch_type


def top_values(
    rows: DataFrame, name: str, k: int, counters: int = COUNTERS, broadcast_candidates: int = BROADCAST_CANDIDATES
) -> DataFrame | None:
    """(name, count) of every value that can be among the ``k`` most frequent, counted exactly; None if not settled.

    ``rows`` has the one column ``name`` with no nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[name].dataType
    run, batch_type = summaries(counters)
    batch_type.append(to_arrow_type(kind))
    schema = T.StructType([T.StructField("v", kind), T.StructField("c", T.LongType()), T.StructField("e", T.LongType())])
    summary = rows.select(name).mapInArrow(run, schema)
    from tallyframe.shared import cut_lineage

    summary = cut_lineage(summary)
    lost = summary.agg(F.sum("e")).first()[0] or 0
    bounds = summary.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("c").alias("lb"))
    kth = bounds.orderBy(F.col("lb").desc()).limit(k).agg(F.min("lb"), F.count(F.lit(1))).first()
    if kth[1] == 0:
        return None if lost else rows.limit(0).select(name, F.lit(0).cast("long").alias("count"))
    least = kth[0] if kth[1] >= k else 0
    candidates = cut_lineage(bounds.where(F.col("lb") + F.lit(lost) >= F.lit(least)).select(F.col("v").alias(name)))
    few = candidates.count() <= broadcast_candidates
    exact = rows.join(F.broadcast(candidates) if few else candidates, name, "left_semi").groupBy(name).agg(
        F.count(F.lit(1)).alias("count")
    )
    if lost == 0:
        return exact
    # The check reads the candidates' rows once; the answer is left lazy, counts combined before its shuffle.
    top = exact.orderBy(F.col("count").desc()).limit(k).agg(F.min("count"), F.count(F.lit(1))).first()
    return exact if top[1] >= k and top[0] > lost else None
