"""Fixed virtual slots: records hash into thousands of slots, slots map to shards, the map has versions.

The hash decides a record's slot for good. What is balanced is the map: version 1 deals slots to shards in
turn, before anything is known of them; bytes are then added up for each slot, and every later version is an
edit of the one before, stored beside it: rebalancing moves slots from full shards to empty ones, growing
moves slots into the new shard only. The map has `SLOTS` rows whatever the data, so it is worked on in the
driver and broadcast; records never are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mediasift.llm.common import ROW, whole_text
from mediasift.sources.shared import stored

SLOTS = 8192
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8

MAP_SCHEMA = "slot int, shard int, shards int, bytes long, rows long, before long"
#: Bits of a generated row number below the number of the task that gave it.
TASK_BITS = 33


class SlotMap:
    """One version of the slot-to-shard map, with the bytes and rows of each slot as last counted."""

    def __init__(self, version: int, shards: int, shard: list[int], size: list[int], rows: list[int]):
        self.version, self.shards, self.shard, self.size, self.rows = version, shards, shard, size, rows

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, size in zip(self.shard, self.size):
            out[shard] += size
        return out

    def counted(self, size: list[int], rows: list[int]) -> SlotMap:
        """The same map with a new count of bytes and rows."""
        return SlotMap(self.version, self.shards, list(self.shard), size, rows)

    def rebalanced(self) -> SlotMap:
        """The next version: while it narrows their gap, the fullest shard gives the emptiest a slot, or a larger
        one for a smaller one where no single slot is small enough."""
        shard, load, size = list(self.shard), self.loads(), self.size
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot in range(len(shard)):
            held[shard[slot]].append((size[slot], slot))
        for _ in range(len(shard)):
            full, slack = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            given, taken = _exchange(held[full], sorted(held[slack]), load[full] - load[slack])
            for item, source, target in ((given, full, slack), (taken, slack, full)):
                if item is not None:
                    held[source].remove(item)
                    held[target].append(item)
                    load[source] -= item[0]
                    load[target] += item[0]
                    shard[item[1]] = target
            if given is None:
                break
        return SlotMap(self.version + 1, self.shards, shard, self.size, self.rows)

    def grown(self) -> SlotMap:
        """The next version, with one more shard; slots move only into it, from the fullest shards."""
        shard, load = list(self.shard), [*self.loads(), 0]
        fair = sum(load) / len(load)
        for slot in sorted(range(len(shard)), key=lambda s: -self.size[s]):
            source = shard[slot]
            if load[-1] + self.size[slot] <= fair and load[source] - self.size[slot] >= fair * 0.98:
                load[source] -= self.size[slot]
                load[-1] += self.size[slot]
                shard[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, shard, self.size, self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each slot, with the rows of its shard that lie in earlier slots."""
        seen = [0] * self.shards
        data = []
        for slot, shard in enumerate(self.shard):
            data.append((slot, shard, self.shards, self.size[slot], self.rows[slot], seen[shard]))
            seen[shard] += self.rows[slot]
        return spark.createDataFrame(data, MAP_SCHEMA)


def _exchange(full: list[tuple[int, int]], slack: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """The (size, slot) to give and the one to take back, if any, that halve the gap best; none if it cannot narrow."""
    fits = [item for item in full if 0 < item[0] < gap]
    if fits:
        return min(fits, key=lambda item: (abs(gap - 2 * item[0]), item)), None
    best: tuple[int, tuple[int, int] | None, tuple[int, int] | None] = (gap, None, None)
    for item in full:
        at = bisect_left(slack, (item[0] - gap // 2, -1))
        for other in slack[max(0, at - 1) : at + 1]:
            if 0 < item[0] - other[0] < gap:
                best = min(best, (abs(gap - 2 * (item[0] - other[0])), item, other), key=lambda b: b[0])
    return best[1], best[2]


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1 before any record is counted: slots to shards in turn."""
    return SlotMap(1, shards, [slot % shards for slot in range(slots)], [0] * slots, [0] * slots)


def first_map(shards: int, size: list[int], rows: list[int]) -> SlotMap:
    """Version 1 where loads are known: slots by falling size, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    shard = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
        load, least = heapq.heappop(heap)
        shard[slot] = least
        heapq.heappush(heap, (load + size[slot], least))
    return SlotMap(1, shards, shard, list(size), list(rows))


def write_map(slot_map: SlotMap, spark: SparkSession, folder: str) -> None:
    """Add this version below `folder`; earlier versions stay readable, and a version is written once only."""
    slot_map.table(spark).coalesce(1).write.mode("error").parquet(f"{folder}/version={slot_map.version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """The version asked for, or the newest."""
    table = spark.read.parquet(folder)
    wanted = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == wanted).orderBy("slot").collect()  # `SLOTS` rows
    return SlotMap(wanted, rows[0]["shards"], [r["shard"] for r in rows], [r["bytes"] for r in rows], [r["rows"] for r in rows])


def rebalance(rows: DataFrame, folder: str) -> SlotMap:
    """Count the records of each slot, edit the newest map below `folder` and write it as the next version."""
    spark = rows.sparkSession
    old = read_map(spark, folder)
    new = old.counted(*slot_loads(rows, len(old.shard))).rebalanced()
    write_map(new, spark, folder)
    return new


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Of each row, stored: doc_id, size in bytes, CRC-32 of the text and virtual slot.

    The slot comes from doc_id, text and, where a row is repeated in full, the number of the copy, so that
    neither rows that share an id nor copies of one row share a slot. Copies are alike, so whichever is
    called the first, the table of slots is the same on every run.
    """
    text = whole_text()
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias(ROW),
            "doc_id",
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.col("doc_id").cast("long"), text).alias("content"),
        ),
        "sharding-rows",
    )
    slot = F.pmod(F.xxhash64("content", "copy"), F.lit(slots)).cast("int")
    return stored(_numbered_copies(rows).select("doc_id", "size", "text_crc32", slot.alias("virtual_slot")), "sharding-records")


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """`rows` with `copy`, from 0 within equal `content`.

    Copies are numbered within the task that read them, which bounds every window, and the copies of earlier
    tasks are added from a table with one row for each content and task.
    """
    rows = rows.withColumn("task", F.shiftright(ROW, TASK_BITS))
    each = rows.groupBy("content", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("content").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = each.select("content", "task", before.alias("earlier")).where("earlier > 0")
    within = F.row_number().over(Window.partitionBy("content", "task").orderBy(ROW)) - 1
    return (
        rows.withColumn("within", within)
        .join(earlier, ["content", "task"], "left")
        .withColumn("copy", F.col("within") + F.coalesce("earlier", F.lit(0)))
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot, empty ones too; `slots` numbers reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    return size, count


def placed(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Each record with its shard, its place in the shard (gapless from 0) and the map's version.

    Places follow slot, then doc_id. Rows are numbered within a slot; a slot's offset in its shard comes
    with the map. Null and empty texts are records of `RECORD_BYTES`; a null doc_id comes first in its
    slot; very long texts are sized whole; repeated rows take slots and places of their own; further columns
    are not read, whatever their names; an empty table gives no rows.
    """
    table = slot_map.table(rows.sparkSession).select(F.col("slot").alias("virtual_slot"), "shard", "before")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(within))
    return numbered.join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
