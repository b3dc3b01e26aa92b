"""Fixed virtual slots [native].

Records are hashed into a fixed number of virtual slots. Bytes are summed by slot, and a versioned map says which shard
holds each slot. A new map gives slots to shards so that their bytes are near equal; rebalancing and growing edit as few
entries of the map as they can, so that only records of edited slots move.

The slots are fixed in number (SLOTS), so a map and the bytes of its slots have at most that many rows at any input size;
only they come to the driver. Ties go to the smaller slot and the smaller shard.

Defined results: a null text has no bytes and the checksum of an empty one; a null doc_id is hashed like any value; rows
equal in doc_id and text share a slot and are numbered apart; an empty table gives no rows; other columns are left out and
never read. Equal texts of different doc_id are records of their own: the law of near equal bytes decides for each record,
so a group of equal texts is spread like any other records, and may be so large that one shard couldn't hold it.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import shared_dir

SLOTS = 8192
OVERHEAD = 16


def virtual_slot(*columns: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame, slot: str = "virtual_slot", size: str = "size") -> dict[int, int]:
    """Bytes of each slot that has any; at most SLOTS rows reach the driver."""
    return {r[0]: r[1] for r in rows.groupBy(slot).agg(F.sum(size)).collect()}


def new_map(load: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: slots by falling bytes, each to the shard that has least."""
    heap = [(0, shard) for shard in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda x: (-load.get(x, 0), x)):
        full, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (full + load.get(slot, 0), shard))
    return out


def rebalanced(before: list[int], load: dict[int, int], shards: int, slack: float = 0.01) -> list[int]:
    """The map with slots moved from the fullest shard to the emptiest, until their difference is within slack of the mean.

    Shards that the map doesn't know yet count as empty; a move that would not narrow the difference ends it.
    """
    out, total = list(before), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(before):
        total[shard] += load.get(slot, 0)
        held[shard].append(slot)
    mean = sum(total) / shards
    while True:
        most, least = max(range(shards), key=lambda x: (total[x], -x)), min(range(shards), key=lambda x: (total[x], x))
        apart = total[most] - total[least]
        fits = [x for x in held[most] if 0 < load.get(x, 0) < apart]
        if apart <= slack * mean or not fits:
            return out
        slot = min(fits, key=lambda x: (abs(apart / 2 - load[x]), x))
        held[most].remove(slot)
        held[least].append(slot)
        out[slot] = least
        total[most] -= load[slot]
        total[least] += load[slot]


def grown(before: list[int], load: dict[int, int]) -> list[int]:
    """The map with one more shard, which alone receives slots: from each old shard until that is down to the new mean."""
    shards = max(before) + 1
    out, total = list(before), [0] * (shards + 1)
    for slot, shard in enumerate(before):
        total[shard] += load.get(slot, 0)
    mean = sum(total) / (shards + 1)
    for slot in sorted(range(len(before)), key=lambda x: (-load.get(x, 0), x)):
        b = load.get(slot, 0)
        if b and total[out[slot]] - b >= mean * 0.999 and total[shards] + b <= mean * 1.001:
            total[out[slot]] -= b
            total[shards] += b
            out[slot] = shards
    return out


def map_frame(spark: SparkSession, shard_of: list[int], version: int = 1) -> DataFrame:
    """The map as rows (version, virtual_slot, shard), made from one literal."""
    parsed = F.from_json(F.lit(json.dumps(shard_of)), "array<int>")
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(parsed).alias("virtual_slot", "shard"))


def save_map(spark: SparkSession, shard_of: list[int], path: str, version: int) -> None:
    """Adds a version to the stored map; versions already there stay as they are."""
    map_frame(spark, shard_of, version).drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard").collect()
    return [shard for _, shard in sorted((r[0], r[1]) for r in rows)]


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    whole = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    df = docs.select("doc_id", (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    return df.withColumn("virtual_slot", virtual_slot("doc_id", "text_crc32", slots=slots))


def assigned(docs: DataFrame, shards: int = 40, slots: int = SLOTS, maps: str | None = None, before: int | None = None) -> DataFrame:
    """Each document's shard under the law of near equal bytes, and its place there, gapless from 0.

    The map is stored under maps as a version and read from there: version 1 is made anew; where an earlier version is
    named, the next is that one edited as little as near equal bytes allow. The place is the number of rows in earlier
    slots of the shard, from the map, plus the row's number in its own slot. So no task sorts more than a slot.
    """
    spark = docs.sparkSession
    maps = maps or shared_dir(spark)
    rows = sized(docs, slots)
    tally = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    load = {k: v[0] for k, v in tally.items()}
    version = 1 if before is None else before + 1
    save_map(spark, new_map(load, shards, slots) if before is None else rebalanced(load_map(spark, maps, before), load, shards), maps, version)
    shard_of = load_map(spark, maps, version)
    first, filled = [0] * slots, [0] * shards
    for slot, shard in enumerate(shard_of):
        first[slot] = filled[shard]
        filled[shard] += tally.get(slot, (0, 0))[1]
    look = lambda name, values: F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{name}>"), F.col("virtual_slot") + 1)
    lookup = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).select("virtual_slot", look("int", shard_of).alias("shard"), look("bigint", first).alias("__before"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("__own", own).join(lookup, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__before") + F.col("__own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
