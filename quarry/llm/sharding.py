"""Sharding over fixed virtual slots: records hash to slots, a stored and versioned map sends slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, written

SLOTS = 8192
#: Rows of a slot are numbered in cells of about so many.
CELL_ROWS = 50_000


def slot_of(slots: int, *keys: Column | str) -> Column:
    """A record's slot; it never changes while the number of slots is the same."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def first_map(sizes: dict[int, int], slots: int, shards: int) -> list[int]:
    """slot -> shard: the largest slots first, each to the shard with fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, 0), shard))
    return out


def rebalanced(old: list[int], sizes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """The map edited for other sizes or more shards: slots move from the fullest to the emptiest shard while
    one is further than `tolerance` from the mean and a move narrows the gap. No other slot moves."""
    out = list(old)
    total = [0] * shards
    mine: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        total[shard] += sizes.get(slot, 0)
        mine[shard].append(slot)
    mean = sum(total) / shards
    while True:
        hi, lo = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        if max(total[hi] - mean, mean - total[lo]) <= tolerance * mean:
            return out
        fit = [v for v in mine[hi] if 0 < sizes.get(v, 0) < gap]
        if not fit:
            return out
        slot = min(fit, key=lambda v: (abs(gap / 2 - sizes[v]), v))
        mine[hi].remove(slot)
        mine[lo].append(slot)
        out[slot] = lo
        total[hi] -= sizes[slot]
        total[lo] += sizes[slot]


class SlotMaps:
    """Versions of a slot-to-shard map as tables below one folder; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slots")

    def store(self, version: int, shard_of: list[int]) -> None:
        rows = list(enumerate(shard_of))
        self.spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("error").parquet(f"{self.path}/v{version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/v{version}")

    def load(self, version: int) -> list[int]:
        return [r.shard for r in self.read(version).orderBy("virtual_slot").collect()]


def shard(docs: DataFrame, *, shards: int = 40, slots: int = SLOTS, maps: SlotMaps | None = None, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the row's place in its shard, from 0), virtual_slot, map_version.

    size is the text's UTF-8 bytes and 16. Records hash by (doc_id, text_crc32) to `slots` virtual slots; rows
    that are repeated hash by their place in the table too, so that no number of them fills one slot.
    Without `version`, bytes are summed by slot and a first map (version 1) is made of them and stored in
    `maps`; else that stored version decides. Bytes of shards differ by less than the largest slot has.

    Null texts have size 16 and crc 0; null ids hash by the text. Equal texts with other ids are records of
    their own, wherever they hash. A text of any length is one record, whole. Slots of equal bytes go by number.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    again = written(rows.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("d"), F.col("text_crc32").alias("t")), "again")
    marked = rows.join(maybe_broadcast(again), rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_crc32 == F.col("t")), "left")
    rows = marked.select("doc_id", "size", "text_crc32", F.when(F.col("t").isNotNull(), F.col("row")).otherwise(-1).alias("row"))
    rows = rows.withColumn("virtual_slot", F.when(F.col("row") < 0, slot_of(slots, "doc_id", "text_crc32")).otherwise(slot_of(slots, "doc_id", "text_crc32", "row")))
    by_slot = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()}  # at most `slots` rows
    maps = maps or SlotMaps(spark)
    if version is None:
        version = 1
        maps.store(version, first_map({k: v[0] for k, v in by_slot.items()}, slots, shards))
    cells = max(1, -(-max((v[1] for v in by_slot.values()), default=0) // CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(11), "doc_id", "text_crc32", "row"), F.lit(cells)))
    held = rows.groupBy("virtual_slot", "cell").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(maps.read(version)), "virtual_slot")
    upto = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = written(held.select("virtual_slot", "cell", "shard", (F.sum("n").over(upto) - F.col("n")).alias("before")), "cells")
    place = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "row")
    out = rows.withColumn("place", F.row_number().over(place) - 1).join(maybe_broadcast(held), ["virtual_slot", "cell"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"), "virtual_slot", F.lit(version).alias("map_version"))
