"""Translation memory (J4): what was translated before is never sent again.

The memory is keyed by ``(source, target, model, segment)``. Any table of that schema can serve (``recall``, ``hits``,
``misses``); ``MemoryTable`` is a layout of one on disk for runs that need a small part of a large memory:

    rows/run=<run>/bucket=<b>/     translations, bucketed by the hash of the key; a run is written as a whole, so storing it
                                   again replaces it
    filter/run=<run>/              which keys a run may hold: bitmaps of a second hash, one row per bucket and
                                   32,768 bits
    retired/into=<run>/            names of runs whose rows a compacted run holds; readers skip them

A run looks its segments up in the filter first and reads only the buckets that may hold one of them. Memory rows are
written before they are joined (``remember``), so a retried stage never pays for the same segment twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.operators.segment import SEGMENT_KEYS
from transloom.session import path_exists

MEMORY_COLUMNS = [*SEGMENT_KEYS, "translation"]


def recall(unique: DataFrame, memory: DataFrame) -> DataFrame:
    """Every segment with its ``translation`` from the memory, NULL where it has none.
    One row per key even if two runs stored the same segment. The grouping comes after the join, whose
    partitioning it shares, so only rows that were asked for are grouped and no exchange is added."""
    found = unique.select(*SEGMENT_KEYS).join(memory.select(*MEMORY_COLUMNS), SEGMENT_KEYS, "left")
    return found.groupBy(*SEGMENT_KEYS).agg(F.min("translation").alias("translation"))


def hits(unique: DataFrame, memory: DataFrame) -> DataFrame:
    return recall(unique, memory).where(F.col("translation").isNotNull())


def misses(unique: DataFrame, memory: DataFrame) -> DataFrame:
    return unique.join(memory.select(*SEGMENT_KEYS), SEGMENT_KEYS, "left_anti")


class MemoryTable:
    """A memory on disk. ``buckets`` and ``bits`` (of the filter, per bucket) are fixed when it is first written: a
    filter of 2^20 bits in each of 256 buckets (at most 32 MB) tells 100 million keys apart with a third of the bits set."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, bits: int = 1 << 20):
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("bucket"), *SEGMENT_KEYS), F.lit(self.buckets)).cast("int")

    def _place(self) -> Column:
        """1 to ``bits``: the key's place in its bucket's filter."""
        return F.pmod(F.xxhash64(F.lit("filter"), *SEGMENT_KEYS), F.lit(self.bits)) + 1

    # --- writing ---------------------------------------------------------------------------------
    def remember(self, translated: DataFrame, run: str | None = None) -> str:
        """Store successful translations as one run; the name of the run."""
        run = run or f"run-{uuid.uuid4().hex}"
        ok = translated.where(F.col("error") == "") if "error" in translated.columns else translated
        rows = f"{self.path}/rows/run={run}"
        ok.select(*MEMORY_COLUMNS, self._bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", *SEGMENT_KEYS) \
            .write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(rows)
        written = self._read_runs([run])
        place = self._place()
        written.groupBy("bucket", F.bitmap_bucket_number(place).alias("chunk")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/filter/run={run}")
        return run

    def compact(self) -> str | None:
        """Put all runs into one, one row per key; the others are skipped from then on. Readers that overlap see a key
        twice at most, which ``recall`` settles. Storing a skipped run again changes nothing: its rows are in the new one."""
        old = self.runs()
        if len(old) < 2:
            return None
        one = self._read_runs(old).groupBy(*SEGMENT_KEYS).agg(F.min("translation").alias("translation"))
        into = self.remember(one, f"compact-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(r,) for r in old], "run string").coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.path}/retired/into={into}")
        return into

    # --- reading ---------------------------------------------------------------------------------
    def runs(self) -> list[str]:
        """The runs that count: those with a filter (it is written last) that no compacted run holds."""
        if not path_exists(self.spark, f"{self.path}/filter"):
            return []
        done = self.spark.read.option("basePath", f"{self.path}/filter").option("recursiveFileLookup", "false") \
            .schema("bucket int, chunk bigint, bits binary, run string").parquet(f"{self.path}/filter")
        found = done.select(F.col("run").cast("string").alias("run")).distinct()
        if path_exists(self.spark, f"{self.path}/retired"):
            gone = self.spark.read.schema("run string").parquet(f"{self.path}/retired/*")
            found = found.join(gone, "run", "left_anti")
        return sorted(r.run for r in found.collect())

    def _read_runs(self, runs: list[str]) -> DataFrame:
        kinds = ", ".join(f"{c} string" for c in MEMORY_COLUMNS) + ", run string, bucket int"
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(kinds).parquet(*[f"{self.path}/rows/run={r}" for r in runs])

    def _filters(self, runs: list[str]) -> DataFrame:
        each = self.spark.read.schema("bucket int, chunk bigint, bits binary").parquet(*[f"{self.path}/filter/run={r}" for r in runs])
        return each.groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))

    def rows(self) -> DataFrame:
        """All rows of the runs that count."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in MEMORY_COLUMNS))
        return self._read_runs(runs).select(*MEMORY_COLUMNS)

    def touched(self, unique: DataFrame, runs: list[str]) -> list[int]:
        """The buckets that may hold one of the segments: at most ``buckets`` numbers reach the driver."""
        bit = F.bitmap_bit_position("_place")
        keyed = unique.select(self._bucket().alias("bucket"), self._place().alias("_place")).select(
            "bucket", F.bitmap_bucket_number("_place").alias("chunk"), bit.alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        maybe = keyed.join(self._filters(runs), ["bucket", "chunk"]).where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
        return sorted(r.bucket for r in maybe.select("bucket").distinct().collect())

    def recall(self, unique: DataFrame, but: str | None = None) -> DataFrame:
        """``recall`` from the buckets that may hold one of the segments. ``but`` names a run that is not read: a replayed run must
        not read what it is about to replace."""
        runs = [r for r in self.runs() if r != but]
        buckets = self.touched(unique, runs) if runs else []
        if not buckets:
            return unique.select(*SEGMENT_KEYS, F.lit(None).cast("string").alias("translation"))
        return recall(unique, self._read_runs(runs).where(F.col("bucket").isin(buckets)))
