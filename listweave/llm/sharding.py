"""Shards over fixed virtual slots.

A record's slot is a hash of its id and text. Bytes are added up per slot, and a stored, versioned
map says which shard each slot is in. A new version is an edit of the last one: slots move one by
one, records never change their slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listweave.session import pinned, run_folder
from listweave.sources.commits import Commits

SLOTS = 4096
ROW_BYTES = 16
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes bigint, slot_rows bigint, before bigint"


@dataclass(frozen=True)
class SlotStats:
    slot: int
    bytes: int
    rows: int


def spread_slots(stats: Iterable[SlotStats], shards: int) -> dict[int, int]:
    """Largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed: dict[int, int] = {}
    for s in sorted(stats, key=lambda s: (-s.bytes, s.slot)):
        size, rows, shard = heapq.heappop(heap)
        placed[s.slot] = shard
        heapq.heappush(heap, (size + s.bytes, rows + s.rows, shard))
    return placed


def rebalanced(placed: dict[int, int], stats: Iterable[SlotStats], shards: int) -> dict[int, int]:
    """An edit of a map for other sizes or a larger number of shards.

    Unknown slots go to the emptiest shard. Then the fullest shard gives the emptiest one the
    largest slot that brings the two closer, as long as there is one.
    """
    sizes = {s.slot: s.bytes for s in stats}
    result = {slot: shard for slot, shard in placed.items() if shard < shards}
    load = [0] * shards
    for slot, shard in result.items():
        load[shard] += sizes.get(slot, 0)
    for slot in sorted(sizes.keys() - result.keys(), key=lambda s: (-sizes[s], s)):
        shard = load.index(min(load))
        result[slot] = shard
        load[shard] += sizes[slot]
    held: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot in sorted(result, key=lambda s: (sizes.get(s, 0), s)):
        held[result[slot]].append(slot)
    while True:
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        # Less than the gap keeps the new larger one of the two below the old one.
        fit = [s for s in held[high] if 0 < sizes.get(s, 0) < gap]
        if not fit:
            return result
        slot = min(fit, key=lambda s: abs(gap - 2 * sizes[s]))
        held[high].remove(slot)
        held[low].append(slot)
        result[slot] = low
        load[high] -= sizes[slot]
        load[low] += sizes[slot]


class SlotMap:
    """Versions of a slot-to-shard map in a folder, one sub-folder each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def write(self, version: int, placed: dict[int, int], stats: Iterable[SlotStats]) -> DataFrame:
        """Stores a version; rows before a slot in its shard are counted in order of slots."""
        before = dict.fromkeys(placed.values(), 0)
        rows = []
        for s in sorted(stats, key=lambda s: s.slot):
            shard = placed[s.slot]
            rows.append((s.slot, shard, s.bytes, s.rows, before[shard]))
            before[shard] += s.rows
        table = self.spark.createDataFrame(rows, MAP_SCHEMA)
        # What a killed attempt may have left is no version.
        table.coalesce(1).write.mode("overwrite").parquet(self._path(version))
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self._path(version))

    def latest(self) -> int:
        """Number of the newest whole version, 0 if there is none."""
        files = Commits(self.spark, self.folder)
        names = [n for n in files.names(self.folder) if n.startswith("version=")]
        numbers = [int(n.removeprefix("version=")) for n in names]
        return max((n for n in numbers if "_SUCCESS" in files.names(self._path(n))), default=0)

    def shards(self, version: int) -> dict[int, int]:
        """Slot to shard: at most as many entries as there are slots."""
        return {r["virtual_slot"]: r["shard"] for r in self.read(version).collect()}


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and ``virtual_slot`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.xxhash64("text").alias("text_key"),
    )


def slot_stats(slotted: DataFrame) -> list[SlotStats]:
    """Bytes and rows of each slot: at most as many entries as there are slots."""
    table = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [SlotStats(r["virtual_slot"], r["b"], r["n"]) for r in table.collect()]


def sharded(
    docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None
) -> DataFrame:
    """Every row of ``docs`` with its shard under the law ``bytes``: sizes of shards near equal.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text, none for null, plus 16), ``text_crc32``
    (of null: that of the empty text), ``law``, ``shard``, ``slot`` (place in the shard, gapless
    from 0, in order of virtual slot, id and text), ``grown_shard`` (null under this law),
    ``virtual_slot`` and ``map_version``. The slot map is stored in ``folder``. If there is one already,
    for other rows or fewer shards, the next version is an edit of it (:func:`rebalanced`), so that
    few slots move.

    Null ids are spread by their texts; rows with equal id and text share a slot, ties in their
    order do not matter as they are equal. Other columns are ignored whatever their names. An empty
    table gives no rows. Slots and their map are bounded by ``slots``, so the map is broadcast.
    """
    spark = docs.sparkSession
    slotted = pinned(with_slot(docs, slots))
    stats = slot_stats(slotted)
    store = SlotMap(spark, folder or run_folder(spark, "slot-map"))
    last = store.latest()
    placed = rebalanced(store.shards(last), stats, shards) if last else spread_slots(stats, shards)
    version = last + 1
    table = store.write(version, placed, stats)
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_key", "size")
    return (
        slotted.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(table.select("virtual_slot", "shard", "before")), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("_n") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(version).alias("map_version"),
        )
    )


