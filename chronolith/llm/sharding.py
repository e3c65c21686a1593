"""Sharding by fixed virtual slots.

A record's key hashes to one of a fixed number of virtual slots; bytes and rows are summed per slot, and a slot map
says which shard holds each slot. The map is a table of as many rows as there are slots, whatever the corpus size,
so it may be planned on the driver and broadcast. It is stored, a folder for each version; a version is never written
twice. Every edit makes a new version: rebalancing moves few slots, from the fullest shards to the emptiest, and leaves
all others where they are. Documents are dealt by the newest version, as it is read back from storage.

A record's key is its id, size and checksum, so neither many texts under one id nor many null ids share a slot. A slot that
holds over twice its part all the same (rows that repeat) is spread: its rows hash by their place in the checkpointed
table instead, over all slots.

Defined cases: a null text has no bytes and CRC-32 zero; rows that repeat get places of their own; a text of any length
counts whole, in one slot; an empty table gives no rows and a map all the same; columns but doc_id and text are not read, so
their names can't clash.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, literal_table, shared_folder

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for every virtual slot; version counts the edits."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    def loads(self, size: dict[int, int]) -> list[int]:
        found = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            found[shard] += size.get(slot, 0)
        return found

    def save(self, spark: SparkSession, path: str) -> None:
        """Stores this version below path; a version that is there already raises."""
        rows = [{"vslot": k, "shard": s, "shards": self.shards} for k, s in enumerate(self.shard_of)]
        literal_table(spark, rows, "vslot: int, shard: int, shards: int").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version of a stored map, or else the newest."""
        found = spark.read.parquet(path)
        version = version or found.agg(F.max("version")).first()[0]
        rows = found.where(F.col("version") == version).select("vslot", "shard", "shards").orderBy("vslot").collect()  # one row a slot
        return SlotMap(tuple(r["shard"] for r in rows), rows[0]["shards"], version)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def even(shards: int, slots: int = SLOTS) -> SlotMap:
    """A map that knows no sizes."""
    return SlotMap(tuple(k % shards for k in range(slots)), shards)


def plan(size: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """A first map: largest slot first, each to the shard with the fewest bytes so far."""
    heap, shard_of = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-size.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + size.get(slot, 0), shard))
    return SlotMap(tuple(shard_of), shards)


def swap(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[int, int] | None:
    """Of slots (size, slot) of the fullest and the emptiest shard, the pair whose exchange narrows the gap most."""
    low, best = sorted(low), None
    for a, x in sorted(high):
        k = bisect_left(low, (a - gap / 2, -1))
        for b, y in low[max(k - 1, 0) : k + 1]:
            if 0 < a - b < gap and (best is None or abs(gap / 2 - (a - b)) < best[0]):
                best = (abs(gap / 2 - (a - b)), x, y)
    return best and best[1:]


def rebalance(now: SlotMap, size: dict[int, int], shards: int | None = None, tolerance: float = 0.02, least: int = 0) -> SlotMap:
    """The next version for new slot sizes or another number of shards: slots leave the fullest shard for the emptiest
    while that narrows the gap and a shard is off the mean by more than tolerance; where no slot does, two are exchanged,
    until the gap is `least` at most. Shards that go are emptied first."""
    shards = shards or now.shards
    shard_of, moved = list(now.shard_of), set()
    load = [0] * max(shards, now.shards)
    held: list[set[int]] = [set() for _ in load]
    for slot, shard in enumerate(shard_of):
        load[shard] += size.get(slot, 0)
        held[shard].add(slot)

    def move(slot: int, to: int) -> None:
        at, n = shard_of[slot], size.get(slot, 0)
        load[at], load[to] = load[at] - n, load[to] + n
        held[at].discard(slot)
        held[to].add(slot)
        shard_of[slot] = to
        moved.add(slot)

    for gone in range(shards, len(load)):
        for slot in sorted(held[gone], key=lambda k: -size.get(k, 0)):
            move(slot, min(range(shards), key=lambda s: load[s]))
    mean = sum(load) / shards
    for _ in range(2 * len(shard_of)):
        high, low = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        fit = [k for k in held[high] if 0 < size.get(k, 0) < gap]
        if not fit:
            pair = swap([(size.get(k, 0), k) for k in held[high]], [(size.get(k, 0), k) for k in held[low]], gap) if gap > least else None
            if pair is None:
                break
            move(pair[0], low)
            move(pair[1], high)
            continue
        move(min(fit, key=lambda k: (abs(gap / 2 - size.get(k, 0)), k)), low)
    return SlotMap(tuple(shard_of), shards, now.version + 1, tuple(sorted(moved)))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row: the only pass over the texts."""
    raw = F.col("text").cast("binary")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    return found.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> list:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).collect()  # a row a slot


def spread(rows: DataFrame, per_slot: list, slots: int) -> tuple[DataFrame, list]:
    """Rows and slot sizes after the rows of slots that hold over twice their part, and over two of the largest rows, are dealt
    over all slots by their place. rows must be checkpointed, which keeps places as they are."""
    part, most = sum(r.bytes for r in per_slot) / slots, max((r.most for r in per_slot), default=0)
    full = [r.vslot for r in per_slot if r.bytes > 2 * part and r.bytes > 2 * most]
    if not full:
        return rows, per_slot
    by_place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    rows = cut(rows.withColumn("vslot", F.when(F.col("vslot").isin(full), by_place).otherwise(F.col("vslot"))))
    return rows, slot_sizes(rows)


def shard(docs: DataFrame, map_path: str, shards: int = 8, slots: int = SLOTS, tolerance: float = 0.0) -> DataFrame:
    """Every row with its virtual slot, shard and gapless place in its shard.

    The newest map at map_path (an even one is stored first where there is none) is rebalanced for the bytes that the
    slots have now, stored as the next version if a slot moves or the number of shards does, and read back.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs, slots))
    rows, per_slot = spread(rows, slot_sizes(rows), slots)
    if not SlotMap.stored(spark, map_path):
        even(shards, slots).save(spark, map_path)
    now = SlotMap.load(spark, map_path)
    if len(now.shard_of) != slots:
        raise ValueError(f"the stored map has {len(now.shard_of)} slots; slots are fixed")
    new = rebalance(now, {r.vslot: r.bytes for r in per_slot}, shards, tolerance, max((r.most for r in per_slot), default=0))
    if new.moved or new.shards != now.shards:
        new.save(spark, map_path)
    held = SlotMap.load(spark, map_path)
    # A place is the slot's first place in its shard, from the slots' counts, plus the row's number in its slot.
    count, first, at = {r.vslot: r.rows for r in per_slot}, [], [0] * shards
    for k, s in enumerate(held.shard_of):
        first.append({"vslot": k, "shard": s, "version": held.version, "first": at[s]})
        at[s] += count.get(k, 0)
    known = F.broadcast(literal_table(spark, first, "vslot: int, shard: int, version: int, first: bigint"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(known, "vslot").withColumn("slot", F.col("first") + F.col("place"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `bytes`: the map deals the slots' summed bytes near equally. Each run keeps its map in a folder of its own."""
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
