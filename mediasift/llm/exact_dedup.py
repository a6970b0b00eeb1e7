"""Exact duplicates by a cuckoo-filter index over digests of normalised texts.

Digests are dealt into buckets. In each bucket a cuckoo filter holds a 16-bit tag for each live digest,
together with the place of its stored key. An incoming digest that hits a tag is verified against the
stored 32-byte key, so that a false hit never merges two texts; one that hits nothing is inserted. When
an insertion overflows, the filter doubles and is filled again from the stored keys. Deletions take a
live digest out of both.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import ROW, SALT, packed, salt_of, unpacked, whole_text
from mediasift.sources.shared import stored

#: Characters that do not count when texts are compared.
SPACES = " \t\n\x0b\x0c\r"

#: Keys that one bucket holds on average; a bucket is worked on in one piece.
BUCKET_KEYS = 20_000
LEAST_BUCKETS = 64

SLOTS = 4
MOST_KICKS = 200
LIVE, DELETE, INSERT = 0, 1, 2
CHARS, DIGEST = "__chars", "__digest"

INDEX_SCHEMA = "bucket int, digest binary, salt int, chars long, has_id int, not_id long, not_row long, size long, first boolean"


class CuckooFilter:
    """Tags of stored keys, `SLOTS` to a slot group, each key in one of two groups."""

    def __init__(self, capacity: int = 16):
        self.keys: list[bytes | None] = []
        self._make(capacity)

    def _make(self, capacity: int) -> None:
        self.groups = 1 << max(2, math.ceil(math.log2(max(capacity, 1) / (SLOTS * 0.8))))
        self.tags = [0] * (self.groups * SLOTS)
        self.refs = [-1] * (self.groups * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Tag (never 0) and the two groups; either group leads to the other by the tag alone."""
        word = int.from_bytes(key[:8], "little")
        tag = (word & 0xFFFF) or 1
        group = (word >> 16) & (self.groups - 1)
        return tag, group, self._other(group, tag)

    def _other(self, group: int, tag: int) -> int:
        return (group ^ (tag * 0x5BD1E995)) & (self.groups - 1)

    def find(self, key: bytes) -> int:
        """Place of the equal stored key, or -1. A hit on the tag alone does not count."""
        tag, one, two = self._places(key)
        for group in (one, two):
            for slot in range(group * SLOTS, group * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[self.refs[slot]] == key:
                    return self.refs[slot]
        return -1

    def insert(self, key: bytes) -> int:
        """Store a key that is not live yet and return its place; grow as often as it takes."""
        self.keys.append(key)
        place = len(self.keys) - 1
        if not self._put(key, place):
            self._grow()
        return place

    def delete(self, key: bytes) -> int:
        """Take a live key out; its place, or -1 if it is not live."""
        tag, one, two = self._places(key)
        for group in (one, two):
            for slot in range(group * SLOTS, group * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[self.refs[slot]] == key:
                    place, self.tags[slot], self.refs[slot] = self.refs[slot], 0, -1
                    self.keys[place] = None
                    return place
        return -1

    def _put(self, key: bytes, place: int) -> bool:
        tag, one, two = self._places(key)
        for group in (one, two):
            for slot in range(group * SLOTS, group * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, place
                    return True
        group = two
        for kick in range(MOST_KICKS):
            slot = group * SLOTS + kick % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            place, self.refs[slot] = self.refs[slot], place
            group = self._other(group, tag)
            for slot in range(group * SLOTS, group * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, place
                    return True
        return False

    def _grow(self) -> None:
        """Twice the room, filled from the stored keys; again if they still overflow."""
        capacity = self.groups * SLOTS
        while True:
            capacity *= 2
            self._make(capacity)
            if all(self._put(key, place) for place, key in enumerate(self.keys) if key is not None):
                return


def _work_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Run a bucket's live rows, then its deletions, then its insertions through one filter.

    Gives each live or inserted row the summary of its digest; `first` marks one row for each digest.
    """
    rows = rows.sort_values("op", kind="stable")
    index = CuckooFilter(len(rows))
    of_row = np.full(len(rows), -1, dtype=np.int64)
    for i, (op, key) in enumerate(zip(rows["op"], rows["digest"], strict=True)):
        if op == DELETE:
            index.delete(key)
        else:
            place = index.find(key)
            of_row[i] = place if place >= 0 else index.insert(key)
    live = np.array([key is not None for key in index.keys] or [False])
    stays = (of_row >= 0) & live[of_row]
    rows, of_row = rows[stays], of_row[stays]
    # the row that stays: most characters, then the smallest id (stored inverted), then the first row
    order = np.lexsort([rows[c].to_numpy() for c in ("not_row", "not_id", "has_id", "chars")])
    best = np.zeros(len(index.keys), dtype=np.int64)
    best[of_row[order]] = order
    sizes = np.zeros(len(index.keys), dtype=np.int64)
    np.add.at(sizes, of_row, rows["size"].to_numpy())
    firsts = np.zeros(len(rows), dtype=bool)
    firsts[np.unique(of_row, return_index=True)[1]] = True
    chosen = best[of_row]
    out = rows[["bucket", "digest", "salt"]].reset_index(drop=True)
    for c in ("chars", "has_id", "not_id", "not_row"):
        out[c] = rows[c].to_numpy()[chosen]
    out["size"], out["first"] = sizes[of_row], firsts
    return out


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def chars_of(column: str = "text") -> Column:
    return F.length(whole_text(column)).cast("long")


def digest_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(whole_text(column)), 256))


def text_keys(docs: DataFrame) -> DataFrame:
    """Of each row, stored: `ROW`, doc_id, code points of the text, SHA-256 of the normalised text."""
    numbered = docs.select("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id())
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return stored(numbered.select(ROW, doc_id, chars_of().alias("chars"), digest_of().alias("digest")), "exact-dedup-keys")


def change_index(changes: DataFrame, buckets: int, index: DataFrame | None = None) -> DataFrame:
    """The index after `changes` (op, digest, salt, chars, has_id, not_id, not_row, size).

    `index` is what an earlier call gave, where `first`; its buckets must be as many. A deleted digest is
    gone with all its rows, unless the same changes insert it again.
    """
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    columns = ["digest", "salt", "chars", "has_id", "not_id", "not_row", "size"]
    rows = changes.select(bucket, "op", *columns)
    if index is not None:
        rows = rows.unionByName(index.where("first").select("bucket", F.lit(LIVE).alias("op"), *columns))
    return rows.groupBy("bucket").applyInPandas(_work_bucket, INDEX_SCHEMA)


def insertions(keys: DataFrame) -> DataFrame:
    """Rows of `text_keys`, those of one digest combined to one for each salt before the shuffle."""
    best = F.max(
        F.struct(
            "chars",
            F.col("doc_id").isNotNull().cast("int").alias("has_id"),
            F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("not_id"),
            F.bitwise_not(ROW).alias("not_row"),
        )
    )
    combined = keys.groupBy("digest", salt_of().alias("salt")).agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    return combined.select(F.lit(INSERT).alias("op"), "digest", "salt", "size", "best.*")


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, math.ceil(rows / BUCKET_KEYS))


def duplicate_groups(keys: DataFrame) -> DataFrame:
    """Each row of `text_keys` (stored) with keep_id, keep_row, group_size, kept and its digest.

    Equal texts form a group; of it stays the row with the most code points, then the smallest doc_id
    (null last), then the first row. Empty and null texts are equal. Rows repeated in full stay once.
    An empty table gives no rows.
    """
    index = change_index(insertions(keys), bucket_count(keys.count()))
    groups = index.select(
        "digest",
        F.col("salt").alias(SALT),
        F.when(F.col("has_id") == 1, F.bitwise_not("not_id")).alias("keep_id"),
        F.bitwise_not("not_row").alias("keep_row"),
        F.col("size").alias("group_size"),
    )
    joined = keys.withColumn(SALT, salt_of()).join(groups, ["digest", SALT])
    return joined.withColumn("kept", F.col(ROW) == F.col("keep_row")).drop(SALT)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without exact duplicates, all columns as they came, whatever their names."""
    numbered = packed(docs).withColumn(ROW, F.monotonically_increasing_id())
    rows = stored(numbered.withColumns({CHARS: chars_of("row.text"), DIGEST: digest_of("row.text")}), "exact-dedup-rows")
    keys = rows.select(ROW, F.col("row.doc_id").cast("long").alias("doc_id"), F.col(CHARS).alias("chars"), F.col(DIGEST).alias("digest"))
    kept = duplicate_groups(keys).where("kept").select(ROW)
    return unpacked(rows.join(kept, ROW, "left_semi"))
