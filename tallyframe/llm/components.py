"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import settle

MOST_ROUNDS = 60


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each value but the least of its component."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half of a round: link neighbours to the least value around them.

    Minima are found by an aggregate that combines before the shuffle and joined back, so
    that Spark can split the join at a value with very many links.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))
    ).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least value of its component) of every value in a link.

    ``edges`` has two columns ``a`` and ``b`` of one type, without nulls. Rounds of large and
    small stars end when the links no longer change; each round is written to the shared folder.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = settle(current, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        current = settle(star(star(current, larger=True), larger=False), "links")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
