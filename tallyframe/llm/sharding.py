"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its key and never changes. Only the map from slots
to shards does: it is a table with a version, and rebalancing writes the next version with
some of its rows edited. Its size is the number of slots, whatever the number of records,
so it may pass through the driver and be broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.common import settle, table
from tallyframe.shared import fresh_path

SLOTS = 8192
SHARDS = 40
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("slot")), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot that has rows; at most one entry for each slot."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r.virtual_slot: (r.bytes, r.rows) for r in sums.collect()}


def first_map(slots: int, shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The map with the fewest useful edits: slots leave shards above the mean for those below.

    Slots are taken from each overfull shard, largest first, as long as they fit in what it
    has too much; then all that were taken go, largest first, to the emptiest shard. A last
    pass does the same with single slots between the fullest and the emptiest shard while
    that lowers the difference between them.
    """
    owned: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    edited = dict(current)
    loose = []
    for slot, shard in sorted(current.items()):
        (owned[shard] if shard < shards else loose).append(slot)
    load = {shard: sum(weight.get(s, 0) for s in owned[shard]) for shard in owned}
    mean = sum(weight.get(s, 0) for s in current) / shards
    for shard, slots in owned.items():
        for slot in sorted(slots, key=lambda s: (-weight.get(s, 0), s)):
            if weight.get(slot, 0) and load[shard] - weight[slot] >= mean:
                load[shard] -= weight[slot]
                loose.append(slot)
    heap = [(total, shard) for shard, total in load.items()]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight.get(s, 0), s)):
        total, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (total + weight.get(slot, 0), shard))
    return swap_ends(edited, weight, shards)


def swap_ends(current: dict[int, int], weight: dict[int, int], shards: int, rounds: int = 2000) -> dict[int, int]:
    owned: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    for slot, shard in current.items():
        owned[shard].add(slot)
    load = {shard: sum(weight.get(s, 0) for s in slots) for shard, slots in owned.items()}
    for _ in range(rounds):
        full, empty = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        fitting = [s for s in owned[full] if 0 < weight.get(s, 0) < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap - 2 * weight[s]), s))
        owned[full].remove(slot)
        owned[empty].add(slot)
        load[full] -= weight[slot]
        load[empty] += weight[slot]
    return {slot: shard for shard, slots in owned.items() for slot in slots}


def grow(current: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The map with one more shard (number ``shards``), which slots only move into."""
    edited = dict(current)
    goal = sum(weight.values()) / (shards + 1)
    taken = {shard: 0 for shard in range(shards)}
    load = {shard: sum(weight.get(s, 0) for s, x in current.items() if x == shard) for shard in range(shards)}
    for slot in sorted(current, key=lambda s: (weight.get(s, 0), s)):
        shard = current[slot]
        if load[shard] - taken[shard] - weight.get(slot, 0) >= goal:
            taken[shard] += weight.get(slot, 0)
            edited[slot] = shards
    return edited


def write_version(spark: SparkSession, folder: str, version: int, slot_map: dict[int, int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Store one version of the map; earlier versions stay readable beside it."""
    rows = [(version, slot, shard, *sizes.get(slot, (0, 0))) for slot, shard in sorted(slot_map.items())]
    path = f"{folder}/version={version}"
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.parquet(path)
    return spark.read.schema(MAP_SCHEMA.removeprefix("version int, ")).parquet(path)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row with its virtual slot, its shard and its place in the shard.

    The first version of the map deals slots out in turn; the second is edited by the bytes
    of each slot, so that shards are nearly equal in bytes. A record counts its UTF-8 bytes
    and 16 more. A hot source or a group of copies is no hot slot, because the slot comes
    from the id. Rows with one id share a slot and follow each other; a null id is hashed
    like a value of its own, a null text has 16 bytes and the checksum 0, an empty table
    gives an empty result.

    Only ids, sizes and checksums are shuffled, never texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    records = settle(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).alias("text_crc32"),
            virtual_slot(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), slots).alias("virtual_slot"),
        ),
        "sizes",
    )
    sizes = slot_sizes(records)
    weight = {slot: total for slot, (total, _) in sizes.items()}
    folder = fresh_path(spark, "slot-map")
    start = first_map(slots, shards)
    write_version(spark, folder, 1, start, sizes)
    slot_map = write_version(spark, folder, 2, rebalance(start, weight, shards), sizes)
    offset = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    places = slot_map.withColumn("offset", F.coalesce(offset, F.lit(0))).select("virtual_slot", "shard", "offset")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("n", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
