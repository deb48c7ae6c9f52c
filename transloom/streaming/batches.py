"""Micro-batch stream operators (T3, T4, T7); the status table (T5) is ``streaming.snapshots``.

``foreachBatch`` turns each trigger into a batch job; writes are keyed by the
batch id so a replayed batch (after a failure) leaves the same result. The
sinks are Parquet folders named by the caller (shared storage on a cluster).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.functions.text import go_trim


def batch_path(root: str, batch_id: int) -> str:
    return os.path.join(root, f"batch_id={batch_id}")


def latest_wins_batch(df: DataFrame) -> DataFrame:
    """T3 for one trigger: per device the newest non-blank text wins, the rest are superseded."""
    live = df.where(go_trim("text") != "")
    return live.groupBy("device").agg(
        F.max_by(F.struct("poll", "text"), F.col("poll")).alias("last"),
        F.count(F.lit(1)).alias("n")).select(
        "device", F.col("last.poll").alias("poll"), go_trim("last.text").alias("text"),
        (F.col("n") - 1).cast("bigint").alias("n_superseded"))


def write_latest_wins(out_root: str):
    """``foreachBatch`` sink for T3: one Parquet folder per batch id, overwritten on replay."""
    def sink(df: DataFrame, batch_id: int) -> None:
        latest_wins_batch(df).write.mode("overwrite").parquet(batch_path(out_root, batch_id))
    return sink


def suppress_duplicates(stream: DataFrame, keys: list[str], ts: str, watermark: str = "10 minutes") -> DataFrame:
    """T4 (set form): drop rows whose keys were seen within the watermark, for feeds where a repeat
    is never wanted. The consecutive rule is ``stateful.stable_input``."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def continuous_translation(settings_raw: DataFrame, results_root: str, memory_path: str,
                           kind: str = "pseudo", options: dict | None = None, compact_every: int = 100):
    """T7 ``foreachBatch`` sink: each trigger's requests go through the flagship plan with
    the memory table; results land under their batch id, memory grows as it runs, a run per trigger. Every
    ``compact_every`` triggers the runs are put into one."""
    from transloom.operators.memory import MemoryTable
    from transloom.plans.corpus import translate_corpus

    def sink(df: DataFrame, batch_id: int) -> None:
        memory = MemoryTable(df.sparkSession, memory_path)
        results = translate_corpus(df, settings_raw, memory=memory, kind=kind, options=options, run=str(batch_id))
        results.write.mode("overwrite").parquet(batch_path(results_root, batch_id))
        if batch_id and batch_id % compact_every == 0:
            memory.compact()
    return sink
