"""Event topics as a stream sink with commit and abort.

    data/<name>.jsonl     the events of one task of one trigger
    commits/<batch>.json  the files of one trigger: its events exist from the moment this file appears

Each task writes a file of its own and hands its name to the driver, which publishes them together; a task or a
trigger that dies leaves files that no commit names, and no half event. A replayed trigger replaces its commit.
Paths go through Arrow's file systems, so any store that Arrow knows (local mounts, HDFS, S3, GCS) will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from transloom.session import path_exists, ship_package

EVENT = "topic string, key string, payload string, ts long"


def _store(root: str):
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root.replace("file:/", "file:///") if root.startswith("file:/") and "://" not in root else root)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator) -> _Written:
        store, root = _store(self.root)
        store.create_dir(f"{root}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{root}/data/{name}") as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(), ensure_ascii=False).encode() + b"\n")
                rows += 1
        return _Written(name, rows)

    def commit(self, messages: list, batchId: int) -> None:
        store, root = _store(self.root)
        store.create_dir(f"{root}/commits", recursive=True)
        listed = [{"file": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        hidden = f"{root}/commits/_{batchId}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps({"batch": batchId, "files": listed}).encode() + b"\n")
        store.move(hidden, f"{root}/commits/{batchId:012d}.json")

    def abort(self, messages: list, batchId: int) -> None:
        store, root = _store(self.root)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/data/{m.name}")


class EventSink(DataSource):
    """``format("transloom_events").option("path", root)``; rows ``(topic, key, payload, ts)``."""

    @classmethod
    def name(cls) -> str:
        return "transloom_events"

    def schema(self) -> str:
        return EVENT

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def event_rows(rows: DataFrame, topic: str, key: str, payload: list[str], ts: str) -> DataFrame:
    """``(topic, key, payload, ts)``, the payload columns as one JSON object, the time in milliseconds."""
    at = F.unix_millis(F.col(ts).cast("timestamp")) if dict(rows.dtypes)[ts].startswith("timestamp") else F.col(ts).cast("bigint")
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"),
                       F.to_json(F.struct(*payload)).alias("payload"), at.alias("ts"))


# The topics that carry data, from the streams that produce them.
def translation_stream(emissions: DataFrame) -> DataFrame:
    """T1 (``timers.coalesce_deltas``): text of a reply as it comes."""
    return event_rows(emissions.withColumnsRenamed({"request_id": "requestId", "text": "delta"}), "translation-stream", "requestId",
                      ["requestId", "delta"], "emit_ms")


def model_download_status(status: DataFrame) -> DataFrame:
    """T5: status rows ``(model, n, status, message, progress)`` as they change."""
    return event_rows(status, "model-download-status", "model", ["model", "status", "message", "progress"], "n")


def clipboard_translate(changes: DataFrame) -> DataFrame:
    """T2 (``timers.change_feed``): text that is to be translated."""
    return event_rows(changes, "clipboard-translate", "device", ["text"], "poll")


def clipboard_error(polls: DataFrame) -> DataFrame:
    """Polls of the change feed that could not be read, or changed while they were."""
    bad = polls.where(~F.coalesce("read_ok", F.lit(False)) | (F.col("seq_after") != F.col("seq")))
    reason = F.when(F.col("read_ok"), F.lit("torn read")).otherwise(F.lit("read failed"))
    return event_rows(bad.withColumn("message", reason), "clipboard-error", "device", ["message"], "poll")


def write_events(events: DataFrame, root: str) -> DataStreamWriter:
    """The sink of a stream of events; the caller names trigger and checkpoint."""
    spark = events.sparkSession
    ship_package(spark)
    spark.dataSource.register(EventSink)
    return events.writeStream.format(EventSink.name()).option("path", root)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The committed events."""
    if not path_exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], EVENT)
    commits = spark.read.schema("batch long, files array<struct<file: string, rows: long>>").json(f"{root}/commits/*.json")
    names = [r.file for r in commits.select(F.explode("files.file").alias("file")).collect()]
    if not names:
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).json([f"{root}/data/{n}" for n in names])
