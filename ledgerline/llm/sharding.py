"""Sharding by fixed virtual slots.

Records are hashed by doc_id into thousands of slots, and bytes are summed for
each slot. A versioned map says which shard each slot belongs to: version 1
deals slots in turn, and every later version is an edit that moves the few slots
which bring the shards' bytes nearest to one another. A record's slot never changes.

Records that repeat a doc_id, or have none, are hashed by that and their number
among them, so that they spread like others; the first of them has its doc_id's own slot.
Sizes are what is evened (the law `bytes`), and documents are dealt one by one: equal texts
are records of their own and may go to different shards.

Null texts have no bytes, and a size of 1. A record isn't divided, so one very long text can
outweigh a shard's even share. An empty table has no places, and its map
stays as it was dealt first. Extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, shared_folder
from ledgerline.llm.mixing import repeats

SLOTS, SHARDS = 4096, 8
#: Part of a shard's even share by which the fullest and the emptiest may differ.
TOLERANCE = 1e-4
#: Ids that repeat, up to which writing shards broadcasts them (8 bytes each).
BROADCAST_IDS = 1 << 18
_MAP = "version int, slot int, shard int"


def edited(sizes: np.ndarray, shard_of: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """A new slot-to-shard map: slots move, or swap, from the fullest to the emptiest shard while that evens them."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, sizes, shards)
    allowed = tolerance * load.sum() / shards
    for _ in range(20 * len(sizes)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        if gap <= allowed:
            break
        here = np.flatnonzero((shard_of == high) & (sizes > 0))
        there = np.flatnonzero((shard_of == low) & (sizes > 0))
        there = there[np.argsort(sizes[there], kind="stable")]
        best, move = gap, None
        if len(here):
            i = here[np.abs(sizes[here] - gap / 2).argmin()]
            best, move = abs(2 * sizes[i] - gap), (i, None)
        if len(there) and len(here) and best > allowed:
            # For each slot here, the slot there whose swap comes nearest to half the gap.
            wanted = sizes[here] - gap / 2
            at = np.searchsorted(sizes[there], wanted)
            for near in (np.clip(at - 1, 0, len(there) - 1), np.clip(at, 0, len(there) - 1)):
                left = np.abs(2 * (sizes[here] - sizes[there][near]) - gap)
                if left.min() < best:
                    best, move = left.min(), (here[left.argmin()], there[near[left.argmin()]])
        if move is None or best >= gap:
            break
        out, back = move
        shard_of[out], load[high], load[low] = low, load[high] - sizes[out], load[low] + sizes[out]
        if back is not None:
            shard_of[back], load[high], load[low] = high, load[high] + sizes[back], load[low] - sizes[back]
    return shard_of


def slot_of(doc_id: F.Column, slots: int = SLOTS, repeat: F.Column | None = None) -> F.Column:
    """The virtual slot of a record; `repeat` is its number among those with its doc_id, 0 for the first."""
    first = F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(slots)).cast("int")
    if repeat is None:
        return first
    return F.when(repeat == 0, first).otherwise(F.pmod(F.xxhash64(doc_id.cast("long"), repeat), F.lit(slots)).cast("int"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, per_slot: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The version after `slot_map`, edited for the bytes in `per_slot` (slot, bytes); one row for each slot passes the driver."""
    spark = slot_map.sparkSession
    now = slot_map.join(per_slot, "slot", "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy("slot").collect()
    found = edited(np.array([r["bytes"] for r in now], np.float64), np.array([r["shard"] for r in now], np.int64), shards)
    return spark.createDataFrame([(r["version"] + 1, r["slot"], int(s)) for r, s in zip(now, found, strict=True)], _MAP)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map's table; earlier versions stay as they are."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the newest unless given."""
    versions = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).select("version", "slot", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place within the shard), virtual_slot and map_version of every row.

    Places are numbered within each virtual slot, by doc_id, from where the
    shard's earlier slots end, so that no shard is sorted as a whole. Version 1 of
    the map and its edit are stored at `map_path`, which has to be new (unless given,
    a folder of the session's checkpoint folder), and documents placed by what is stored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = checkpointed(docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(doc_id, F.lit(0)).alias("key")))
    # Rows without doc_id have the key 0, and so have those whose doc_id is 0.
    rows = checkpointed(repeats(rows, "key", ["doc_id", "text_crc32", "size"]))
    rows = rows.withColumn("virtual_slot", slot_of(F.col("key"), slots, F.col("repeat")))
    per_slot = checkpointed(rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    store_map(first_map(spark, shards, slots), path)
    store_map(rebalanced(stored_map(spark, path), per_slot.select(F.col("virtual_slot").alias("slot"), "bytes"), shards), path)
    slot_map = stored_map(spark, path)
    # One row for each virtual slot, whose number is fixed.
    counted = slot_map.withColumnRenamed("slot", "virtual_slot").join(F.broadcast(per_slot), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("key", "repeat")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "virtual_slot", F.col("version").alias("map_version")
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write the rows of `docs` as Parquet, a folder for each shard of a version of the map, as `shard_documents` places them.

    Every task writes what it has of each shard; no shard passes one task. Rows that repeat
    a doc_id, or have none, are numbered in the same order as there; those alike in doc_id, size and
    checksum may stand for one another. Only they are shuffled, unless ids that repeat are too many to broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    told = {"doc_id": doc_id, "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "key": F.coalesce(doc_id, F.lit(0))}
    rows = docs.select(F.struct("*").alias("doc"), *[c.alias(name) for name, c in told.items()])
    repeated = checkpointed(rows.groupBy("key").count().where("count > 1").select("key"))
    if repeated.count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    alone = rows.join(repeated, "key", "left_anti").withColumn("repeat", F.lit(0).cast("long"))
    several = repeats(checkpointed(rows.join(repeated, "key", "left_semi")), "key", ["doc_id", "text_crc32", "size"])
    both = alone.select("doc", "key", "repeat").union(several.select("doc", "key", "repeat"))
    where = slot_map.select(F.col("slot").alias("_slot"), "shard")
    placed = both.join(F.broadcast(where), slot_of(F.col("key"), slots, F.col("repeat")) == F.col("_slot"))
    placed.select("doc", "shard").write.partitionBy("shard").parquet(path)
