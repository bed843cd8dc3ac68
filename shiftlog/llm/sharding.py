"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots once and for all; bytes are summed
per slot; the map from slots to shards is a small table of versions, and a
rebalance writes a new version that moves as few slots as it can.  The sizes
of the shards then follow the slots' bytes (law ``bytes``): they differ by
about the smallest slot that could still move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlog.llm.common import stored
from shiftlog.session import scratch_dir

#: Virtual slots: fixed for the life of a data set.
SLOTS = 8192
#: Bytes counted for each record besides its text.
RECORD_BYTES = 8

_MAP = "version int, slot int, shard int"


def balance(slot_bytes: dict[int, int], shards: int, current: dict[int, int]) -> dict[int, int]:
    """Edits of ``current`` (slot -> shard) that make the shards' bytes near
    equal; returns the moved slots only.

    Shards above the mean give slots (largest first) until they are at most
    at the mean, slots of shards that no longer exist are free; free slots go
    to the emptiest shard, largest first; then pairs of shards trade single
    slots while that brings the fullest and the emptiest closer.
    """
    size = {s: slot_bytes.get(s, 0) for s in current}
    mean = sum(size.values()) / shards
    held: list[list[int]] = [[] for _ in range(shards)]
    load, free = [0] * shards, []
    for slot in sorted(current, key=lambda s: (size[s], s)):
        shard = current[slot]
        if shard >= shards or load[shard] + size[slot] > mean:
            free.append(slot)
        else:
            held[shard].append(slot)
            load[shard] += size[slot]
    heap = [(load[i], i) for i in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-size[s], s)):
        total, i = heapq.heappop(heap)
        held[i].append(slot)
        heapq.heappush(heap, (total + size[slot], i))
    load = [sum(size[s] for s in h) for h in held]
    for _ in range(64 * shards):
        high, low = max(range(shards), key=lambda i: load[i]), min(range(shards),
                                                                   key=lambda i: load[i])
        gap = load[high] - load[low]
        best = min(held[high], key=lambda s: abs(gap - 2 * size[s]), default=None)
        if best is None or abs(gap - 2 * size[best]) >= gap:
            break
        held[high].remove(best)
        held[low].append(best)
        load[high] -= size[best]
        load[low] += size[best]
    return {s: i for i, h in enumerate(held) for s in h if current[s] != i}


#: Copies of one record that one task numbers.
CHUNK = 65_536


class SlotMap:
    """The versions of one map, as a Parquet table; version 0 deals the slots
    in turn, and every later version holds only the slots it moves."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
        out = cls(spark, path, slots)
        out._write(0, {s: s % shards for s in range(slots)})
        return out

    def _write(self, version: int, moves: dict[int, int]) -> None:
        rows = [(version, s, i) for s, i in sorted(moves.items())]
        self.spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> dict[int, int]:
        """slot -> shard as of a version (the last one by default); one entry
        per slot, so its size is fixed."""
        rows = self.spark.read.schema(_MAP).parquet(self.path)
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        last = rows.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))
        return {r["slot"]: r["shard"] for r in last.collect()}

    def version(self) -> int:
        return self.spark.read.schema(_MAP).parquet(self.path).agg(F.max("version")).first()[0]

    def rebalance(self, slot_bytes: dict[int, int], shards: int) -> int:
        """Writes a version whose shards (also more or fewer than before) have
        near equal bytes; returns its number."""
        version = self.version() + 1
        moves = balance(slot_bytes, shards, self.read())
        # a version that moves nothing still exists: it repeats one slot
        self._write(version, moves or {0: self.read()[0]})
        return version


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row, written once.

    The slot hashes the id, the text's checksum and, so that copies of one
    record cannot overload a slot, the number of the copy.  It depends on the
    rows alone, not on how files are split: equal rows are counted, and the
    counts give rows numbered from 0 again, a large count in chunks that
    different tasks take.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    chunks = (sized.groupBy(*key).agg(F.count("*").alias("n"))
              .select(*key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1,
                                                      F.lit(CHUNK).cast("long"))).alias("first"))
              .repartition(*key, "first"))
    last = F.least(F.col("n"), F.col("first") + CHUNK) - 1
    rows = chunks.select(*key, F.explode(F.sequence("first", last)).alias("copy"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int")
    return stored(rows.withColumn("virtual_slot", slot).drop("copy"), "records")


def shard(docs: DataFrame, shards: int, map_path: str | None = None,
          slots: int = SLOTS) -> DataFrame:
    """Every row's shard and its place there: doc_id, size, text_crc32,
    virtual_slot, map_version, shard, place (gapless from 0 in each shard).

    ``map_path`` names an existing or new slot map; without one a new map is
    written to the shared folder.  Null text has no bytes and checksum 0, null
    and repeated ids are rows like any other, an empty table gives no rows,
    other columns are ignored.  Places are numbered slot by slot: a task sorts
    one slot, never a shard.
    """
    spark = docs.sparkSession
    rows = records(docs, slots)
    per_slot = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"),
                                                F.count("*").alias("n")).collect()  # <= slots
    if map_path is None:
        slot_map = SlotMap.create(spark, scratch_dir(spark, "slot_map"), shards, slots)
    else:
        slot_map = SlotMap(spark, map_path, slots)
    version = slot_map.rebalance({r["virtual_slot"]: r["bytes"] for r in per_slot}, shards)
    of = slot_map.read(version)
    counts, taken, starts = {r["virtual_slot"]: r["n"] for r in per_slot}, [0] * shards, []
    for slot in range(slots):
        starts.append((slot, of[slot], taken[of[slot]]))
        taken[of[slot]] += counts.get(slot, 0)
    places = spark.createDataFrame(starts, "virtual_slot int, shard int, first long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("nth", F.row_number().over(within) - 1)
            .join(F.broadcast(places), "virtual_slot")  # one row per slot: of fixed size
            .select("doc_id", "size", "text_crc32", "virtual_slot",
                    F.lit(version).alias("map_version"), "shard",
                    (F.col("first") + F.col("nth")).alias("place")))
