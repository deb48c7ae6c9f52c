"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal text are a group and stay together. Groups sorted by size enter the bin whose remaining
capacity is the tightest that holds them; the bins' remaining capacities are kept in a balanced tree. The capacity is
the smallest with which the groups need no more than the wanted number of shards (found by bisection); a group that is
larger than an even share gets a shard of its own first, and the rest share the others evenly.

A corpus has more groups than one task should see, so packing has two levels. Heavy groups (more than 1/1024 of an
even share of the bytes or rows; their number is bounded by that) are packed as they are. Light groups are dealt by
hash into blocks, sorted, and streamed through the same best fit into pallets of at most 1/1024 of a share; each
block keeps only its open pallets' remaining capacities in memory. Heavy groups and pallets, at most
``2 * 1024 * shards`` each plus one pallet for each block of 50,000 groups, are then packed into shards on the driver, through
the same tree.

Slots are numbered in pieces: rows of a shard are dealt by hash, numbered inside a piece, and shifted by the counts of
the pieces before.

Edge cases: null and empty text are equal, with size 1; repeated rows each get their own slot; equal sizes are taken
in any order; with fewer groups than shards, shards stay empty; an empty table gives no rows; other columns are
ignored. A group larger than an even share can't be split, so its shard is as large as the group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import cut, pieces, width
from transloom.session import ship_package

SHARDS = 16
#: Heavy groups and pallets are measured in this part of an even share.
FINE = 1_024
BLOCK_GROUPS = 50_000
SLOT_ROWS = 100_000


class CapacityTree:
    """Bins by remaining capacity in a binary tree over the bits of the capacity: each step to the tightest fit goes
    down one of ``bits`` levels, so the tree is balanced by construction."""

    def __init__(self, top: int):
        self.bits = max(1, int(top).bit_length())
        self.below: dict[tuple[int, int], int] = {}  # (level, prefix) -> bins under it
        self.bins: dict[int, list[int]] = {}

    def _count(self, room: int, by: int) -> None:
        for level in range(self.bits + 1):
            key = (level, room >> level)
            n = self.below.get(key, 0) + by
            if n:
                self.below[key] = n
            else:
                del self.below[key]

    def add(self, room: int, name: int) -> None:
        self.bins.setdefault(room, []).append(name)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) with the least room of at least ``size``."""
        if size >> self.bits:
            return None
        level, prefix = 0, size
        while (level, prefix) not in self.below:  # up, until a larger neighbour has a bin
            while level <= self.bits and (prefix & 1 or (level, prefix + 1) not in self.below):
                level, prefix = level + 1, prefix >> 1
            if level > self.bits:
                return None
            prefix += 1
            while level:  # down to its smallest
                level, prefix = level - 1, prefix << 1
                if (level, prefix) not in self.below:
                    prefix += 1
        room = prefix
        name = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
        self._count(room, -1)
        return room, name


class BestFit:
    """Bins of one capacity; items must come in decreasing size."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.n = capacity, CapacityTree(capacity), 0

    def place(self, size: int) -> int:
        room, name = self.tree.take(size) or (self.capacity, self.n)
        self.n += name == self.n
        if room > size:
            self.tree.add(room - size, name)
        return name


def _fits(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Best-fit-decreasing into at most ``shards`` bins."""
    fit = BestFit(capacity)
    out = [fit.place(size) for size in sizes]
    return out if fit.n <= shards else None


def assign(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item (sizes in decreasing order), the largest shard as small as best fit makes it."""
    out, first, rest = [], 0, sum(sizes)
    while first < shards - 1 and len(sizes) > first and sizes[first] * (shards - first) > rest:
        out.append(first)  # larger than an even share of what is left
        rest -= sizes[first]
        first += 1
    sizes, left = sizes[first:], shards - first
    if not sizes:
        return out
    low, high = -(-rest // left), rest
    low = max(low, sizes[0])
    best = _fits(sizes, low, left)
    if best is None:
        step = max(1, low // 4096)
        while best is None:  # the answer is near the lower bound: widen, then bisect
            low, high, step = low + 1, low + step, step * 2
            best = _fits(sizes, high, left)
            low = high if best is None else low
        while low < high:
            mid = (low + high) // 2
            tried = _fits(sizes, mid, left)
            if tried is None:
                low = mid + 1
            else:
                best, high = tried, mid
    return out + [first + b for b in best]


def _pallets(batches: Iterable[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Light groups sorted by block, then decreasing bytes."""
    block, fit = None, None
    for pdf in batches:
        names = []
        for b, size in zip(pdf["block"].tolist(), pdf["bytes"].tolist()):
            if b != block:
                block, fit = b, BestFit(capacity)
            names.append(b << 32 | fit.place(size))
        yield pdf[["digest", "bytes"]].assign(pallet=names)


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    ship_package(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
                           F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("digest")), "sized")
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    n_groups, total, n_rows = groups.agg(F.count("*"), F.sum("bytes"), F.sum("n")).first()
    if not n_groups:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    fine = max(1, total // (shards * FINE))
    is_heavy = (F.col("bytes") > fine) | (F.col("n") > max(1, n_rows // (shards * FINE)))
    heavy = [(bytes(r[0]), int(r[1])) for r in groups.where(is_heavy).select("digest", "bytes").collect()]
    blocks = pieces(n_groups, BLOCK_GROUPS)
    light = groups.where(~is_heavy).select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(blocks)).alias("block"))
    packed = cut(light.repartition(width(spark, blocks), "block").sortWithinPartitions("block", F.desc("bytes"), "digest")
                 .mapInPandas(lambda it: _pallets(it, fine), "digest binary, bytes bigint, pallet bigint"), "pallets")
    pallets = [(int(r[0]), int(r[1])) for r in packed.groupBy("pallet").agg(F.sum("bytes")).collect()]
    items = sorted([(size, 0, name) for name, size in heavy] + [(size, 1, name) for name, size in pallets],
                   key=lambda x: (-x[0], x[1], x[2]))
    placed = assign([size for size, _, _ in items], shards)
    heavy_at = spark.createDataFrame([(bytearray(n), s) for (_, k, n), s in zip(items, placed) if k == 0], "digest binary, shard int")
    pallet_at = spark.createDataFrame([(n, s) for (_, k, n), s in zip(items, placed) if k == 1], "pallet bigint, shard int")
    of_light = packed.join(F.broadcast(pallet_at), "pallet").select("digest", F.col("shard").alias("light_shard"))
    known = rows.join(F.broadcast(heavy_at), "digest", "left")
    in_heavy = known.where(F.col("shard").isNotNull())
    in_light = known.where(F.col("shard").isNull()).drop("shard").join(of_light, "digest").withColumnRenamed("light_shard", "shard")
    both = cut(in_heavy.unionByName(in_light).withColumn("part", F.pmod(
        F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(pieces(n_rows, SLOT_ROWS)))), "sharded")
    counts = both.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards * pieces rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")) \
        .select("shard", "part", "before")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return both.withColumn("inside", inside).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("bigint").alias("slot"))
