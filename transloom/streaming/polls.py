"""Poll files of a change feed as a stream source.

    device=<number>/<name>.jsonl    polls of one device, a JSON object a line; a device's names ascend

A device writes one file after the other and never changes an earlier one, so its position is the name of the last
file that was read. The offset of a trigger holds a position for each device, and the checkpoint of the query keeps it: a
restart goes on behind it, and a trigger that is run again reads the same files. A device's newest file counts once it ends
in a newline; until then (it is being written, a torn read) it is left and offered again by the next trigger. A device that
stopped in the middle of a line and went on with a new file keeps that line as a refused one.

The driver lists names and reads the last byte of each device's newest file; tasks read the files, JSON is parsed by Spark.
An offset takes some 40 bytes a device. Files can be removed once a trigger behind them is committed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from transloom.session import ship_package
from transloom.streaming.events import _store

LINE = "device string, file string, line long, value string"
POLL = "poll long, seq long, seq_after long, read_ok boolean, origin string, text string, ts timestamp"
FOLDER = "device="
PARTITION_BYTES = 32 * 1024 * 1024
BATCH_LINES, BATCH_BYTES = 10_000, 8 * 1024 * 1024


class _Folder:
    """The devices' files, by name."""

    def __init__(self, root: str):
        self.store, self.root = _store(root)

    def listed(self) -> dict[str, list[tuple[str, int]]]:
        """Device -> (name, bytes) of its files in order."""
        from pyarrow import fs

        found: dict[str, list[tuple[str, int]]] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            parts = info.path[len(self.root.rstrip("/")) + 1:].split("/")
            if info.type == fs.FileType.File and len(parts) == 2 and parts[0].startswith(FOLDER) and parts[1][0] not in "._":
                found.setdefault(parts[0][len(FOLDER):], []).append((parts[1], info.size))
        return {device: sorted(files) for device, files in sorted(found.items())}

    def path(self, device: str, name: str) -> str:
        return f"{self.root}/{FOLDER}{device}/{name}"

    def whole(self, device: str, name: str, size: int) -> bool:
        if not size:
            return False
        with self.store.open_input_file(self.path(device, name)) as f:
            f.seek(f.size() - 1)
            return f.read(1) == b"\n"

    def waiting(self, after: dict[str, str]) -> dict[str, list[str]]:
        """Device -> names of its whole files behind its position."""
        out = {}
        for device, files in self.listed().items():
            new = [f for f in files if f[0] > after.get(device, "")]
            if new and not self.whole(device, *new[-1]):
                new.pop()
            if new:
                out[device] = [name for name, _ in new]
        return out


@dataclass
class _Files(InputPartition):
    files: tuple[tuple[str, str], ...]


def _planned(folder: _Folder, start: dict[str, str], end: dict[str, str], most: int) -> list[_Files]:
    """The files of ``start`` < name <= ``end``, put together up to ``most`` bytes a task."""
    out, open_files, open_bytes = [], [], 0
    for device, files in folder.listed().items():
        for name, size in files:
            if not start.get(device, "") < name <= end.get(device, ""):
                continue
            if open_files and open_bytes + size > most:
                out.append(_Files(tuple(open_files)))
                open_files, open_bytes = [], 0
            open_files.append((device, name))
            open_bytes += size
    return out + ([_Files(tuple(open_files))] if open_files else [])


def _lines(root: str, partition: _Files) -> Iterator:
    """Record batches of ``LINE``, bounded by rows and bytes; a longer line is a batch of its own."""
    import io

    import pyarrow as pa

    schema = pa.schema([("device", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("value", pa.string())])
    folder = _Folder(root)
    rows, held = [], 0
    for device, name in partition.files:
        with folder.store.open_input_stream(folder.path(device, name)) as raw, io.BufferedReader(raw) as f:
            for i, line in enumerate(f):
                if rows and (len(rows) == BATCH_LINES or held + len(line) > BATCH_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
                rows.append((device, name, i, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                held += len(line)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.limit = int(options["maxFilesPerTrigger"]) if "maxFilesPerTrigger" in options else None
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.at: dict | None = None  # the offset that was offered last

    def initialOffset(self) -> dict:
        return {"devices": {}, "next": ""}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        after = self.at["devices"]
        waiting = _Folder(self.root).waiting(after)
        if not waiting:
            return self.at
        position, turn = dict(after), self.at["next"]
        if self.limit is None:
            position |= {device: names[-1] for device, names in waiting.items()}
        else:  # one file a device and round, from the device whose turn it is
            order = sorted(waiting, key=lambda device: (device < turn, device))
            left, depth = self.limit, 0
            while left and order:
                order = [device for device in order if len(waiting[device]) > depth]
                for device in order[:left]:
                    position[device] = waiting[device][depth]
                if order:
                    turn = order[left % len(order)] if left < len(order) else order[0]
                left, depth = max(0, left - len(order)), depth + 1
        self.at = {"devices": position, "next": turn}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        if self.at is None:  # a restarted query names the offset that it reached before it asks for the next
            self.at = end
        return [] if start == end else _planned(_Folder(self.root), start["devices"], end["devices"], self.most)

    def read(self, partition: _Files) -> Iterator:
        return _lines(self.root, partition)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[_Files]:
        folder = _Folder(self.root)
        return _planned(folder, {}, {device: names[-1] for device, names in folder.waiting({}).items()}, self.most) or [_Files(())]

    def read(self, partition: _Files) -> Iterator:
        return _lines(self.root, partition)


class PollSource(DataSource):
    """``format("transloom_polls").option("path", root)``: a row a line. ``maxFilesPerTrigger`` bounds what a trigger admits,
    shared among the devices in turn; ``partitionBytes`` is what one task reads."""

    @classmethod
    def name(cls) -> str:
        return "transloom_polls"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def parse_polls(lines: DataFrame) -> DataFrame:
    """``LINE`` rows to polls ``(device, poll, seq, seq_after, read_ok, origin, text, ts, error)``. A line that is no poll (no JSON
    object, no poll number or counter, a device that is no number) keeps its reason in ``error``, NULL for the others; its
    other columns are NULL but for the device. A missing ``seq_after`` equals ``seq``; blank lines are skipped."""
    poll = F.from_json("value", f"{POLL}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select(F.expr("try_cast(device AS bigint)").alias("device"), poll.alias("p"))
    p = F.col("p")
    error = (F.when(F.col("device").isNull(), F.lit("device is no number"))
             .when(p["_bad"].isNotNull(), F.lit("poll is no JSON object"))
             .when(p["poll"].isNull() | p["seq"].isNull(), F.lit("poll without number or counter")))
    good = error.isNull()
    keep = lambda column: F.when(good, column)
    return rows.select(
        "device", keep(p["poll"]).alias("poll"), keep(p["seq"]).alias("seq"),
        keep(F.coalesce(p["seq_after"], p["seq"])).alias("seq_after"),
        keep(F.coalesce(p["read_ok"], F.lit(False))).alias("read_ok"), keep(p["origin"]).alias("origin"),
        keep(p["text"]).alias("text"), keep(p["ts"]).alias("ts"), error.alias("error"))


def _source(spark: SparkSession) -> str:
    ship_package(spark)
    spark.dataSource.register(PollSource)
    return PollSource.name()


def read_polls(spark: SparkSession, root: str) -> DataFrame:
    """All polls that have landed, whole files only, refused lines with their ``error``."""
    return parse_polls(spark.read.format(_source(spark)).option("path", root).load())


def stream_polls(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The same rows as they land. ``max_files`` bounds a trigger; with ``availableNow`` Spark asks a source once, so a run
    then ends after one such share (without a bound after all that has landed)."""
    stream = spark.readStream.format(_source(spark)).option("path", root)
    return parse_polls((stream if max_files is None else stream.option("maxFilesPerTrigger", str(max_files))).load())


def readable(polls: DataFrame) -> DataFrame:
    """Polls without the refused lines, as ``timers.change_feed`` and ``operators.feed.change_feed`` take them."""
    return polls.where(F.col("error").isNull()).drop("error")
