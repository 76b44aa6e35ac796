"""SimHash near-duplicates by the general pigeonhole principle.

If two fingerprints differ in at most ``distance`` bits, and the bits are parted into m
groups with thresholds that sum to ``distance - m + 1`` (each at least -1), then in some
group they differ in no more bits than its threshold. Correlated bits are put into one
group, the number of groups and their thresholds are chosen by dynamic programming on
estimated costs, and fingerprints that agree in a group, but for as many bits as its
threshold allows, are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.llm.common import fresh, map_batches, settle, table, with_columns
from tallyframe.llm.components import components, stars

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 4, 4
#: Cost of comparing two fingerprints, where making, moving and sorting one key costs 1.
PAIR_COST = 0.03
#: Fingerprints with one key that are compared pair by pair; more are linked by `midpoints`.
RUN_LIMIT = 4096
#: Crowded fingerprints that one task of `midpoints` takes, each with the 2,081 values around it.
CROWD_AT_ONCE = 1024
SHINGLES_AT_ONCE = 1 << 16
#: Rows of 24 bytes that are broadcast at most.
BROADCAST_ROWS = 1_000_000


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 where more than half of the hashes of the text's word shingles have it."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        first, ends = first[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        first, ends = first[:1], ends[-1:]
    n, counts = len(first), np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(first[at : at + SHINGLES_AT_ONCE].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist())
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as a signed 64-bit number, of every row."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return map_batches(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, print long")


# ---------------------------------------------------------------- the plan of a search


@dataclass(frozen=True)
class Group:
    """Bits that belong together, the threshold of the group, and what its keys and pairs cost."""

    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """What of a fingerprint is compared: the group's bits without ``threshold`` of them, in every way."""
        if self.threshold < 0:
            return []
        return [sum(1 << b for b in self.bits if b not in left) for left in combinations(self.bits, self.threshold)]


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                bits = bit_matrix(batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False))
                total += bits.T @ bits
                n += len(bits)
        values = np.r_[n, total.ravel()].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "n"])

    rows = prints.select("print").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(BITS * BITS + 1)
    for row in rows:
        values[row["at"]] = row["n"]
    return int(values[0]), values[1:].reshape(BITS, BITS)


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    """A row of 64 numbers 0 or 1 for each fingerprint, lowest bit first."""
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)


def agreement(n: int, both: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints agree in bits i and j; on the diagonal, in bit i."""
    p = np.diag(both) / n
    p11 = both / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    agree = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    np.fill_diagonal(agree, p**2 + (1 - p) ** 2)
    return agree


def group_bits(n: int, both: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """Bits in ``groups`` groups of nearly equal size; each next bit is the one most correlated with its group."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlated = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    free, made = set(range(BITS)), []
    for k in range(groups):
        size = BITS // groups + (k < BITS % groups)
        others = sorted(free)
        start = max(others, key=lambda b: (correlated[b, others].sum(), -b))
        group = [start]
        free.remove(start)
        while len(group) < size:
            best = max(free, key=lambda b: (correlated[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        made.append(tuple(group))
    return made


def group_cost(bits: tuple[int, ...], n: int, agree: np.ndarray, threshold: int) -> float:
    """Estimated keys and comparisons of one group.

    Each bit's chance of agreeing is taken given that the bit before it in the group does.
    The chances of all ways to leave ``threshold`` bits out are summed by a polynomial.
    """
    if threshold < 0:
        return 0.0
    ways = np.zeros(threshold + 1)  # by the number of bits left out so far
    ways[0] = 1.0
    count = np.zeros(threshold + 1)
    count[0] = 1.0
    for k, bit in enumerate(bits):
        chance = agree[bit, bit] if k == 0 else agree[bits[k - 1], bit] / agree[bits[k - 1], bits[k - 1]]
        ways[1:], ways[0] = ways[1:] * chance + ways[:-1], ways[0] * chance
        count[1:] = count[1:] + count[:-1]
    return n * count[threshold] + PAIR_COST * ways[threshold] * n * (n - 1) / 2


def allocate(groups: list[tuple[int, ...]], n: int, agree: np.ndarray, distance: int) -> tuple[float, list[Group]]:
    """Thresholds of at least -1 with the sum ``distance - m + 1`` and the least estimated cost."""
    best: dict[int, tuple[float, list[Group]]] = {0: (0.0, [])}
    for bits in groups:
        following: dict[int, tuple[float, list[Group]]] = {}
        for threshold in range(-1, min(distance, len(bits) - 1, 3) + 1):
            cost = group_cost(bits, n, agree, threshold)
            for total, (spent, chosen) in best.items():
                entry = (spent + cost, [*chosen, Group(bits, threshold)])
                if total + threshold not in following or entry[0] < following[total + threshold][0]:
                    following[total + threshold] = entry
        best = following
    return best[distance - len(groups) + 1]


def search_plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[Group]:
    """The cheapest plan over all numbers of groups, for ``n`` distinct fingerprints."""
    agree = agreement(max(n, 1), both)
    plans = [allocate(group_bits(max(n, 1), both, m), n, agree, distance) for m in range(2, distance + 2)]
    return min(plans, key=lambda plan: plan[0])[1]


# ---------------------------------------------------------------- links


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint64))


def links_of_runs(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of one key, as stars: no more of them than fingerprints."""
    left, right, at, step = [], [], np.arange(len(keys) - 1), 1
    held = 0
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[popcount(prints[at] ^ prints[at + step]) <= distance]
        left.append(prints[near])
        right.append(prints[near + step])
        held += len(near)
        if held > 1 << 20:
            a, b = stars(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
        step += 1
    if not left:
        return prints[:0], prints[:0]
    return stars(np.concatenate(left), np.concatenate(right))


def verify_sorted(distance: int):
    """Compare fingerprints with equal keys in a stream sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys) or keys[0] == keys[-1]:
                continue  # a run that may go on
            whole = np.searchsorted(keys, keys[-1])
            yield as_batch(*links_of_runs(keys[:whole], prints[:whole], distance))
            keys, prints = keys[whole:], prints[whole:]
        yield as_batch(*links_of_runs(keys, prints, distance))

    return run


def as_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def midpoints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Exact links without comparing pairs, for fingerprints that crowd under one key.

    Two fingerprints are at most ``distance`` apart if and only if some value lies within
    half of it from one and the rest from the other. Every fingerprint is linked to the
    least one that shares such a value with it. The work grows with the fingerprints, not
    with their pairs: a value has no more of them than there are values around it. The
    minimum is taken in a window, as in a join Spark would judge the values by the size of
    their fingerprints, some thousand times too small, and broadcast them by way of the driver.
    """
    near, far = distance // 2, distance - distance // 2

    def flips(most: int) -> list[int]:
        made = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(BITS), k)]
        return [signed(m) for m in made]

    if far > 2:
        raise ValueError("midpoints are for distances up to 4")
    values = F.array(*map(F.lit, flips(far))) if far < 2 else F.concat(
        F.array(*map(F.lit, flips(1))),
        F.flatten(F.transform(F.array(*map(F.lit, flips(1)[1:])), lambda x: F.transform(F.array(*map(F.lit, flips(1)[1:])), lambda y: x.bitwiseXOR(y)))),
    )
    spread = prints.select("print").repartition(max(1, -(-prints.count() // CROWD_AT_ONCE)), "print")
    around = spread.select("print", F.explode(F.array_distinct(values)).alias("flip")).select(
        "print", F.col("print").bitwiseXOR(F.col("flip")).alias("value")
    )
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("value"))) <= near
    least = F.min(F.when(close, F.col("print"))).over(Window.partitionBy("value"))
    return around.select(F.col("print").alias("a"), least.alias("b")).where("a <> b").distinct()


def link_prints(prints: DataFrame, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links between distinct fingerprints that give the components of all links of at most ``distance`` bits.

    ``prints`` has one row for each distinct fingerprint. Keys with more than ``run_limit``
    fingerprints are taken apart and linked by `midpoints`, so no task holds a crowded key.
    """
    n, both = bit_counts(prints)
    plan = search_plan(n, both, distance)
    masks = [signed(mask) for group in plan for mask in group.masks()]
    listed = F.posexplode(F.array(*map(F.lit, masks)).cast("array<bigint>")).alias("at", "mask")
    keyed = prints.select("print", listed).select(F.xxhash64("at", F.col("print").bitwiseAND(F.col("mask"))).alias("key"), "print")
    crowded = settle(keyed.groupBy("key").count().where(F.col("count") > run_limit).select("key"), "crowded")
    crowds = not crowded.isEmpty()
    rest = keyed.join(crowded, "key", "left_anti") if crowds else keyed
    links = rest.repartition("key").sortWithinPartitions("key", "print").mapInArrow(verify_sorted(distance), "a long, b long")
    if crowds:
        crowd = settle(keyed.join(crowded, "key", "left_semi").select("print").distinct(), "crowd")
        links = links.unionByName(midpoints(crowd, distance))
    return links


def grouped_prints(docs: DataFrame, id_column: str, text_column: str, shingle: int, distance: int, run_limit: int) -> DataFrame:
    """``doc_id``, ``print``, ``root`` (a fingerprint that names the group) and ``component_id`` of every row."""
    prints = settle(fingerprints(docs, id_column, text_column, shingle), "prints")
    firsts = settle(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = components(link_prints(firsts.select("print"), distance, run_limit))
    rooted = firsts.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("print", "root", "component_id"), "print")


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows are linked if their fingerprints differ in at most ``distance`` bits; the component
    is the smallest ``doc_id`` that can be reached. Equal fingerprints meet in one aggregate
    and only distinct ones are searched. A null text has no words, like an empty one: its
    fingerprint is zero and it is linked like any other. Repeated rows are returned as often
    as they come; a null id is never the smallest, and a component of null ids only has a
    null id. An empty table gives an empty result.
    """
    found = grouped_prints(docs, id_column, text_column, shingle, distance, run_limit)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id.

    Rows that repeat an id and a fingerprint are told apart by nothing else, so one of them
    stays. A row without an id stays only if its group has no row with one. The keys of the
    rows to drop are broadcast up to `BROADCAST_ROWS` of them; more are joined by a shuffle.
    """
    found = grouped_prints(docs, id_column, text_column, shingle, distance, run_limit)
    rows = found.groupBy("root", "doc_id", "print").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "print")).alias("best"))
    own, key, held = (fresh(docs, name) for name in ("_judged_id", "_judged_print", "_print"))
    judged = settle(
        rows.join(best, "root").select(
            F.col("doc_id").alias(own), F.col("print").alias(key), "n",
            (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("print") == F.col("best.print"))).alias("stays"),
        ),
        "judged",
    )
    added = StructType([StructField(held, LongType(), False)])
    printed = with_columns(docs, text_column, added, lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]])
    same = F.col(id_column).eqNullSafe(F.col(own)) & (F.col(held) == F.col(key))
    apart = judged.where("not stays or n > 1").select(own, key)
    small = apart.count() <= BROADCAST_ROWS
    kept = printed.join(F.broadcast(apart) if small else apart, same, "left_anti")
    repeated = judged.where("stays and n > 1").select(own, key)
    if not repeated.isEmpty():
        again = printed.join(F.broadcast(repeated) if small else repeated, same, "left_semi")
        kept = kept.unionByName(again.dropDuplicates([id_column, held]))
    return kept.select(*docs.columns)


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
