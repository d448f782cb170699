"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of slots, for good. Bytes are summed by slot, and the slot-to-shard map is a small
versioned table: version 0 deals the slots round without knowing any bytes, rebalancing or growing edits some of its rows and
moves those slots only. Records are placed by the newest version.

Defined results: a null text has size 1 and the crc of no bytes; a null key hashes like a value of its own, spread by the
text's crc; repeated rows (same key and text) are numbered and the number is hashed too, so that they spread over all slots;
an empty table gives an empty table under a complete map. Other columns do not matter. The law is ``bytes``: shards have near
equal bytes, as far as single records allow.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm.store import stored

SLOTS = 4096
#: Each slot's records are numbered in so many parts, so that no task holds a whole slot.
PARTS = 16
#: Shards differ by at most twice this part of their mean where single slots allow it.
TOLERANCE = 0.002


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, part.

    Repeated rows are numbered in each partition of the stored rows; counts by partition give the offsets.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
                              F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("_piece"))
                  .withColumn("_hash", F.xxhash64(F.lit("slot"), "doc_id", "text_crc32")), "slot-rows")
    earlier = W.partitionBy("_hash").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (rows.groupBy("_hash", "_piece").agg(F.count(F.lit(1)).alias("_count"))
               .select("_hash", "_piece", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before")))
    own = W.partitionBy("_hash", "_piece").orderBy("doc_id", "text_crc32", "size")
    numbered = (rows.withColumn("_number", F.row_number().over(own) - 1).join(offsets, ["_hash", "_piece"])
                .withColumn("_number", F.col("_number") + F.col("_before")))
    hashed = F.when(F.col("_number") == 0, F.col("_hash")).otherwise(F.xxhash64("_hash", "_number"))
    return numbered.select("doc_id", "size", "text_crc32", F.pmod(hashed, F.lit(slots)).cast("int").alias("virtual_slot"),
                           F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(PARTS)).cast("int").alias("part"))


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes by slot; a row for each slot at most comes to the driver."""
    return {r[0]: int(r[1]) for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0: slots go round the shards."""
    return {slot: slot % shards for slot in range(slots)}


def _loads(placed: dict[int, int], sizes: dict[int, int], shards: int) -> list[int]:
    loads = [0] * shards
    for slot, shard in placed.items():
        loads[shard] += sizes.get(slot, 0)
    return loads


def rebalanced(placed: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited map: while the fullest and the emptiest shard differ by more than twice the tolerance, in parts of the mean,
    the slot nearest to half of the difference moves. A shard whose every slot is too large for that keeps what it has."""
    placed, loads = dict(placed), _loads(placed, sizes, shards)
    allowed = 2 * tolerance * sum(loads) / shards
    slots_of: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in placed.items():
        if sizes.get(slot, 0):
            slots_of[shard].append((sizes[slot], slot))
    for held in slots_of:
        held.sort()
    open_ = set(range(shards))
    while open_:
        full = max(open_, key=lambda s: (loads[s], -s))
        empty = min(range(shards), key=lambda s: (loads[s], s))
        gap, held = loads[full] - loads[empty], slots_of[full]
        if gap <= allowed:
            break
        at = bisect_left(held, (gap / 2, -1))
        near = [h for h in held[max(0, at - 1):at + 1] if h[0] < gap]
        if not near:
            open_.discard(full)
            continue
        size, slot = min(near, key=lambda h: (abs(h[0] - gap / 2), h))
        held.remove((size, slot))
        insort(slots_of[empty], (size, slot))
        placed[slot] = empty
        loads[full] -= size
        loads[empty] += size
    return placed


def grown(placed: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map with one shard more: each old shard gives up slots of about its share, all to the new shard."""
    placed, loads = dict(placed), _loads(placed, sizes, shards)
    mean = sum(loads) / (shards + 1)
    for slot in sorted(placed, key=lambda s: (-sizes.get(s, 0), s)):
        shard, size = placed[slot], sizes.get(slot, 0)
        if size and loads[shard] - size >= mean:
            placed[slot] = shards
            loads[shard] -= size
    return placed


def map_table(spark: SparkSession, versions: list[dict[int, int]]) -> DataFrame:
    """The stored map: version, virtual_slot, shard. Every version is complete, an unchanged slot keeps its shard."""
    rows = [(v, slot, shard) for v, placed in enumerate(versions) for slot, shard in sorted(placed.items())]
    return stored(spark.createDataFrame(rows, "version int, virtual_slot int, shard int"), "slot-map")


def newest_map(versions: DataFrame) -> DataFrame:
    """virtual_slot, shard and version of the newest version; the map has ``slots`` rows a version."""
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).select("virtual_slot", "shard", "version")


def place(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard, virtual_slot, version."""
    rows = stored(records(docs, key, text, slots), "slot-records")
    first = first_map(shards, slots)
    versions = map_table(docs.sparkSession, [first, rebalanced(first, slot_sizes(rows), shards, tolerance)])
    newest = newest_map(versions)
    # places: those of earlier parts of the shard, then the row number in the own part
    parts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("count")).join(newest, "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("virtual_slot", "part", "shard", "version",
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("number", F.row_number().over(own)).join(offsets, ["virtual_slot", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "virtual_slot", "version"))
