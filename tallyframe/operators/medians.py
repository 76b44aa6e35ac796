"""Exact medians from mergeable KLL rank sketches.

1. One aggregate gives every group its number of values and a KLL sketch of them; tasks
   build sketches of their rows and Spark merges them, so a group that holds a third of
   the table leaves each task as one sketch.
2. The sketch names two values that, but for its rank error, enclose the middle one or two
   ranks. A second aggregate counts, per group, the values below the lower bound and those
   between the bounds, and sketches the latter. Whether the middle lies between the bounds
   is then known exactly.
3. Where it does and at most ``final`` values lie between the bounds (or the bounds are
   equal), only those values are ordered, as (value, weight) rows of their group, and the
   middle is read off. A larger slice is narrowed again by its own sketch, up to
   ``rounds`` times; a group whose middle escaped its bounds (the sketch's error beyond
   its margin, which the tests provoke) or that is still too large is left to
   ``median_by_ranges``, which is exact at any size.

Groups with at most ``final`` values need no bounds. Bounds are compared with the value as
a double, which keeps order, so counts below and between them are exact ranks of the
values themselves; the chosen values are averaged as ``median_by_ranges`` does.
The table of bounds has one row per group; it is broadcast up to ``broadcast_groups``
groups (counted), else joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.missing import col
from tallyframe.operators.ranges import median_by_ranges
from tallyframe.shared import cut_lineage

#: Accuracy of the sketches (their rank error is about 0.1 % of a group) and the margin of ranks added to each side.
SKETCH_K, MARGIN = 2048, 0.004
#: Values of one group that are ordered at the end at most; rounds of narrowing at most.
FINAL, ROUNDS = 1 << 16, 4
#: Points of the grid of ranks at which sketches are read.
GRID = 2000
#: Groups whose bounds are broadcast at most.
BROADCAST_GROUPS = 1 << 20

V = "_tally_v"


def median_by_sketches(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    final: int = FINAL,
    rounds: int = ROUNDS,
    margin: float = MARGIN,
    sketch_k: int = SKETCH_K,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Exact median of ``value`` per group of ``keys``; a group without values has NULL."""
    group = [col(k) for k in keys]
    rows = df.select(*group, col(value).alias(V))
    number = F.col(V).cast("double")
    stats = rows.groupBy(*group).agg(
        F.count(V).alias("_n"), F.kll_sketch_agg_double(number, F.lit(sketch_k)).alias("_s")
    )
    stats = cut_lineage(stats.select(*group, "_n", F.expr("(_n + 1) div 2").alias("_lo"), F.expr("_n div 2 + 1").alias("_hi"), "_s"))
    few = stats.count() <= broadcast_groups

    def joined(state: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(state) if few else state, list(keys))

    def bounded(state: DataFrame, base: str, size: str, sketch: str) -> DataFrame:
        """Bounds around ranks ``_lo`` and ``_hi`` (counted over the group) from the sketch of the values after ``base``.

        The sketch is read at a fixed grid of ranks (Spark takes only constant ranks), and
        the grid points outside the margins are taken.
        """
        lower = F.greatest(F.lit(0.0), (F.col("_lo") - F.col(base)) / F.col(size) - margin)
        upper = F.least(F.lit(1.0), (F.col("_hi") - F.col(base)) / F.col(size) + margin)
        grid = F.kll_sketch_get_quantile_double(sketch, F.lit([i / GRID for i in range(GRID + 1)]))
        return state.select(
            *group, "_lo", "_hi",
            F.element_at(grid, F.floor(lower * GRID).cast("int") + 1).alias("_l"),
            F.element_at(grid, F.least(F.ceil(upper * GRID).cast("int"), F.lit(GRID)) + 1).alias("_u"),
        )

    empty = stats.where("_n = 0").select(*group, F.lit(None).cast("double").alias(out))
    small = stats.where(f"_n BETWEEN 1 AND {final}").select(
        *group, "_lo", "_hi", F.lit(None).cast("double").alias("_l"), F.lit(None).cast("double").alias("_u"), F.lit(0).cast("long").alias("_below")
    )
    state = bounded(stats.where(f"_n > {final}").withColumn("_zero", F.lit(0)), "_zero", "_n", "_s")
    finished, fallen = [small], []
    for _ in range(rounds):
        state = cut_lineage(state)
        if not state.limit(1).count():
            break
        inside = (number >= F.col("_l")) & (number <= F.col("_u"))
        counted = joined(state).groupBy(*group, "_lo", "_hi", "_l", "_u").agg(
            F.count(F.when(number < F.col("_l"), 1)).alias("_below"),
            F.count(F.when(inside, 1)).alias("_inside"),
            F.kll_sketch_agg_double(F.when(inside, number), F.lit(sketch_k)).alias("_s"),
        )
        counted = cut_lineage(counted.withColumn("_ok", (F.col("_below") < F.col("_lo")) & (F.col("_below") + F.col("_inside") >= F.col("_hi"))))
        done = F.col("_ok") & ((F.col("_inside") <= final) | (F.col("_l") == F.col("_u")))
        finished.append(counted.where(done).select(*group, "_lo", "_hi", "_l", "_u", "_below"))
        fallen.append(counted.where(~F.col("_ok")).select(*group))
        # Ranks within the slice: those of the group less the values below it.
        state = bounded(counted.where(F.col("_ok") & ~done), "_below", "_inside", "_s")
    fallen.append(cut_lineage(state).select(*group))

    ready = finished[0]
    for part in finished[1:]:
        ready = ready.unionByName(part)
    ready = cut_lineage(ready)
    between = (F.col("_l").isNull() | (number >= F.col("_l"))) & (F.col("_u").isNull() | (number <= F.col("_u")))
    weighted = (
        rows.join(F.broadcast(ready) if few else ready, list(keys))
        .where(F.col(V).isNotNull() & between)
        .groupBy(*group, "_lo", "_hi", "_below", F.col(V))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    until = Window.partitionBy(*group).orderBy(V).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = weighted.withColumn("_until", F.col("_below") + F.sum("_w").over(until))
    picked = placed.where((F.col("_until") - F.col("_w") < F.col("_hi")) & (F.col("_until") >= F.col("_lo")))
    halves = F.min(V).cast("double") * 0.5 + F.max(V).cast("double") * 0.5
    medians = picked.groupBy(*group).agg(halves.alias(out)).unionByName(empty)

    lost = fallen[0]
    for part in fallen[1:]:
        lost = lost.unionByName(part)
    lost = cut_lineage(lost)
    if lost.limit(1).count():
        rest = df.join(F.broadcast(lost) if few else lost, list(keys), "left_semi")
        medians = medians.unionByName(median_by_ranges(rest, keys, value, out))
    return medians

