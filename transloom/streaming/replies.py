"""Replies matched to their requests as both arrive (J5 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.operators import reply
from transloom.streaming.batches import batch_path

REPLY_COLUMNS = ["attempt", "http_status", "content_type", "body"]


def correlate(requests: DataFrame, replies: DataFrame, wait: str = "2 minutes", watermark: str = "10 minutes") -> DataFrame:
    """``(request_id, model, asked_at)`` and ``(request_id, attempt, http_status, content_type, body, landed_at)``, two streams,
    to one row per request and reply. A reply counts if it lands within ``wait`` of its request. Replies of unknown ids are
    dropped; a request without a reply leaves with ``status`` NO_REPLY once the watermark has passed its interval.

    Both sides' state ends with the interval, so it holds the requests of ``wait`` and ``watermark`` only. Rows later than
    ``watermark`` are dropped and counted (``metrics.StreamCounts``).
    """
    asked = requests.select("request_id", "model", "asked_at").withWatermark("asked_at", watermark)
    landed = replies.select(F.col("request_id").alias("_of"), *REPLY_COLUMNS, "landed_at").withWatermark("landed_at", watermark)
    in_time = (F.col("request_id") == F.col("_of")) & (F.col("landed_at") >= F.col("asked_at")) \
        & (F.col("landed_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    return asked.join(landed, in_time, "left_outer").select(
        "request_id", "model", "asked_at", *REPLY_COLUMNS, "landed_at",
        F.when(F.col("landed_at").isNull(), F.lit("NO_REPLY")).otherwise(F.lit("REPLIED")).alias("status"))


def results(correlated: DataFrame) -> DataFrame:
    """Result rows of one batch of ``correlate``: decoded replies (C7), and NO_REPLY with its message."""
    decoded = reply.decode_replies(correlated.where("status = 'REPLIED'").select("request_id", *REPLY_COLUMNS))
    none = correlated.where("status = 'NO_REPLY'").select(
        "request_id", "status", F.lit("").alias("text"), F.lit(K.MSG_NO_TRANSLATION).alias("error"))
    return decoded.select("request_id", "status", "text", "error").unionByName(none)


def write_results(root: str):
    """``foreachBatch`` sink: decoded results, one folder per batch id, rewritten on replay."""
    def sink(df: DataFrame, batch_id: int) -> None:
        results(df).write.mode("overwrite").parquet(batch_path(root, batch_id))
    return sink
