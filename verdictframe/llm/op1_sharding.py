"""Fixed virtual slots: records are hashed into thousands of slots, bytes are summed per slot, and a versioned map
from slots to shards is balanced on those sums and edited, slot by slot, when shards are added or sizes drift."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stash, text_of

SLOTS = 4096
#: Copies of one row (same id and text) are placed in lots of so many.
LOT = 64


@dataclass
class SlotMap:
    """Slot -> shard. ``moves`` are the slots that this version moved: (slot, from, to)."""

    version: int
    shards: int
    shard_of: list[int]
    moves: list[tuple[int, int, int]] = field(default_factory=list)

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Append this version; earlier versions stay readable."""
        self.as_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/version={self.version:06d}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> "SlotMap":
        """The given version, or the newest."""
        rows = spark.read.parquet(f"{folder.rstrip('/')}/version=*").toDF("version", "shards", "slot", "shard")
        version = version if version is not None else rows.agg(F.max("version")).first()[0]
        own = sorted((r["slot"], r["shard"], r["shards"]) for r in rows.where(F.col("version") == version).collect())
        return SlotMap(version, own[0][2], [s for _, s, _ in own])


def balanced(sizes: list[int], shards: int) -> SlotMap:
    """Version 1: largest slot first into the lightest shard; ties go to the lower number."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (load + sizes[slot], s))
    return SlotMap(1, shards, shard_of)


def rebalanced(old: SlotMap, sizes: list[int], shards: int, tolerance: float = 0.02) -> SlotMap:
    """The next version: few slots move until every shard is within ``tolerance`` of the mean, or no move helps.

    New shards begin empty. Each step takes a slot from the heaviest shard to the lightest: the largest one that is
    at most half their difference, so loads approach each other and each move is worth its bytes.
    """
    if shards < old.shards:
        raise ValueError("shards can be added, not removed")
    shard_of, own = list(old.shard_of), [[] for _ in range(shards)]
    for slot, s in enumerate(shard_of):
        own[s].append(slot)
    load = [sum(sizes[i] for i in x) for x in own]
    for x in own:
        x.sort(key=lambda i: (sizes[i], i))
    mean, moved = sum(load) / shards, {}
    while True:
        top, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        room = (load[top] - load[low]) / 2
        if load[top] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        fits = [i for i in own[top] if 0 < sizes[i] <= room]
        if not fits:
            break
        slot = fits[-1]
        own[top].remove(slot)
        own[low].append(slot)
        own[low].sort(key=lambda i: (sizes[i], i))
        load[top] -= sizes[slot]
        load[low] += sizes[slot]
        shard_of[slot], moved[slot] = low, (slot, old.shard_of[slot], low)
    moves = [m for m in sorted(moved.values()) if m[1] != m[2]]
    return SlotMap(old.version + 1, shards, shard_of, moves)


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def lots(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per lot: doc_id, size, text_crc32, lot, copies, virtual_slot.

    Rows that agree in id, size and checksum are counted on the map side, whatever their number, and split into lots
    of 64 that are hashed apart, so that repeated rows don't fill one slot.
    """
    t = text_of(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"))
    n = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    last = F.floor((F.col("copies") - 1) / LOT)
    n = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("lot"))
    return n.select(
        "doc_id", "size", "text_crc32", "lot", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT).cast("long").alias("copies"),
        slot_of(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("lot"), slots=slots).alias("virtual_slot"))


def slot_totals(lot_rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of each slot; at most ``slots`` rows come to the driver."""
    out = [0] * slots, [0] * slots
    sums = lot_rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n"))
    for r in sums.collect():
        out[0][r["virtual_slot"]], out[1][r["virtual_slot"]] = r["b"], r["n"]
    return out


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text", slot_map: SlotMap | None = None) -> DataFrame:
    """Every row with its shard and its place there; the law is ``bytes``: sizes of shards are near equal.

    size: UTF-8 bytes of the text and one more; null counts as an empty text. ``slot``: place within the shard, without
    gaps from 0, by virtual slot and then id. Null ids, repeated ids and repeated rows are rows like any other; an
    empty table gives an empty result. ``grown_shard`` is null, as shards follow sizes and not the id alone. Only the
    slot sums come to the driver and only the slot table, of ``slots`` rows, is broadcast. A row larger than the mean
    shard can't be split, so it bounds how equal shards can be.
    """
    spark = docs.sparkSession
    rows = stash(lots(docs, key, text, slots))
    sizes, counts = slot_totals(rows, slots)
    smap = slot_map or balanced(sizes, shards)
    before, starts = [0] * smap.shards, []
    for slot, n in enumerate(counts):
        starts.append((slot, smap.shard_of[slot], before[smap.shard_of[slot]]))
        before[smap.shard_of[slot]] += n
    places = spark.createDataFrame(starts, T.StructType([
        T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType())]))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "lot")
    before_lot = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    placed = rows.withColumn("before", before_lot).join(F.broadcast(places), "virtual_slot")
    first = F.col("start") + F.col("before")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(smap.version).alias("map_version"))


def route(docs: DataFrame, slot_map: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows of ``docs`` with ``shard`` added by a stored map, without a shuffle: what a writer partitions by.

    Here a repeated row always follows its first lot; an existing column ``shard`` is replaced.
    """
    t = text_of(text)
    slot = slot_of(F.col(key), (F.octet_length(t) + 1).cast("long"), F.crc32(F.encode(t, "UTF-8")), F.lit(0).cast("long"), slots=len(slot_map.shard_of))
    table = F.array(*[F.lit(s) for s in slot_map.shard_of])
    return docs.withColumn("shard", F.element_at(table, slot + 1))
