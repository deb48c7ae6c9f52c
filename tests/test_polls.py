"""Poll files as a stream: positions survive a restart, triggers are bounded, torn files are offered again."""
import json
import os
import tempfile

import pytest

from conftest import SF_SMALL
from test_streaming import _run
from transloom.operators import feed as batch_feed
from transloom.sources import fixtures as fx
from transloom.sources.tables import table
from transloom.streaming import events, polls, timers


def land(root, device, name, rows, end="\n"):
    folder = os.path.join(root, f"device={device}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + end)


def poll(n, seq=None, text="t"):
    return {"poll": n, "seq": n if seq is None else seq, "seq_after": n if seq is None else seq, "read_ok": True, "origin": "user",
            "text": text, "ts": "2024-01-01T00:00:00Z"}


def folder(label):
    return tempfile.mkdtemp(prefix=f"transloom-{label}-")


class Log:
    """A sink that notes the polls of each trigger."""

    def __init__(self):
        self.batches = {}

    def __call__(self, df, batch_id):
        self.batches[batch_id] = sorted((r.device, r.poll) for r in df.collect())

    def all(self):
        return sorted(p for batch in self.batches.values() for p in batch)


def start(stream, sink, checkpoint):
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def drain(stream, sink, checkpoint):
    q = start(stream, sink, checkpoint)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_restart_neither_repeats_nor_skips(spark):
    root, checkpoint, first, second = folder("polls"), folder("chk"), Log(), Log()
    for d in (1, 2):
        land(root, d, "0001.jsonl", [poll(1), poll(2)])
    drain(polls.stream_polls(spark, root), first, checkpoint)
    land(root, 1, "0002.jsonl", [poll(3)])
    land(root, 3, "0001.jsonl", [poll(1)])
    drain(polls.stream_polls(spark, root, max_files=1), second, checkpoint)
    assert first.all() == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert second.all() == [(1, 3), (3, 1)] and len([b for b in second.batches.values() if b]) == 2


def test_failed_trigger_reads_the_same_files_again(spark):
    root, checkpoint, log = folder("polls"), folder("chk"), Log()
    land(root, 1, "0001.jsonl", [poll(1)])
    drain(polls.stream_polls(spark, root, max_files=2), log, checkpoint)
    for n in range(2, 7):
        land(root, 1, f"000{n}.jsonl", [poll(n)])
    tried = []

    def fails(df, batch_id):
        tried.append((batch_id, sorted(r.poll for r in df.collect())))
        raise ValueError("lost")

    with pytest.raises(Exception):
        drain(polls.stream_polls(spark, root, max_files=2), fails, checkpoint)
    land(root, 1, "0007.jsonl", [poll(7)])
    drain(polls.stream_polls(spark, root, max_files=2), log, checkpoint)
    assert tried == [(1, [2, 3])] and log.batches[1] == [(1, 2), (1, 3)]
    assert log.all() == [(1, n) for n in range(1, 8)]


def test_triggers_are_bounded_and_devices_take_turns(spark):
    root, log = folder("polls"), Log()
    for d in range(1, 6):
        for n in range(1, 3 if d > 1 else 10):
            land(root, d, f"{n:04d}.jsonl", [poll(n)])
    drain(polls.stream_polls(spark, root, max_files=3), log, folder("chk"))
    batches = [b for _, b in sorted(log.batches.items()) if b]
    assert max(map(len, batches)) == 3 and len(batches) == 6
    assert log.all() == sorted((d, n) for d in range(1, 6) for n in range(1, 3 if d > 1 else 10))
    seen = [d for b in batches for d, _ in b]
    assert set(seen[:6]) == {1, 2, 3, 4, 5}  # a device with many files waits for the others


def test_torn_file_is_offered_again(spark):
    root, log = folder("polls"), Log()
    land(root, 1, "0001.jsonl", [poll(1)])
    land(root, 1, "0002.jsonl", [poll(2), '{"poll": 3, "se'], end="")
    land(root, 2, "0001.jsonl", [], end="")
    land(root, 2, "_hidden", [poll(9)])
    q = start(polls.stream_polls(spark, root), log, folder("chk"))
    try:
        q.processAllAvailable()
        assert log.all() == [(1, 1)]
        assert [r.poll for r in polls.read_polls(spark, root).collect()] == [1]
        land(root, 1, "0002.jsonl", [poll(2), poll(3)])
        land(root, 2, "0001.jsonl", [poll(1)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert log.all() == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_refused_lines_keep_their_reason(spark):
    root = folder("polls")
    land(root, 1, "0001.jsonl", [poll(1, text="ü  \"q\""), "{oops", "", "[1]", {"poll": 2}, {"poll": 3, "seq": 7}, poll(4)], end='\n{"poll": 5')
    land(root, 1, "0002.jsonl", [poll(6)])  # the device went on: the torn line above is a refused one
    land(root, "x", "0001.jsonl", [poll(1)])
    rows = polls.read_polls(spark, root).collect()
    assert sorted(r.poll for r in rows if r.error is None) == [1, 3, 4, 6]
    assert sorted(r.error for r in rows if r.error) == [
        "device is no number", "poll is no JSON object", "poll is no JSON object", "poll is no JSON object",
        "poll without number or counter"]
    assert next(r.text for r in rows if r.poll == 1 and r.error is None) == "ü  \"q\""
    assert [(r.seq_after, r.read_ok) for r in rows if r.poll == 3] == [(7, False)]
    told = events.clipboard_error(polls.read_polls(spark, root)).collect()
    assert len(told) == 6 and {r.topic for r in told} == {"clipboard-error"}
    assert polls.read_polls(spark, folder("empty")).count() == 0


def test_large_files_are_spread_over_tasks(spark):
    root = folder("polls")
    for n in range(12):
        land(root, 1, f"{n:04d}.jsonl", [poll(n, text="x" * 1000)])
    ends = {"devices": {"1": "0010.jsonl"}, "next": ""}
    reader = polls._StreamReader({"path": root, "partitionBytes": "4000"})
    parts = reader.partitions({"devices": {"1": "0001.jsonl"}, "next": ""}, ends)
    assert [len(p.files) for p in parts] == [3, 3, 3] and reader.at == ends


def test_change_feed_from_files_equals_batch(spark):
    rows = fx.feed(table(spark, SF_SMALL, "events"))
    root = folder("polls")
    by_device = {}
    for r in rows.orderBy("poll").collect():
        by_device.setdefault(r.device, []).append(r.asDict() | {"ts": r.ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")})
    for device, found in by_device.items():
        for i in range(0, len(found), 40):
            land(root, device, f"{i:08d}.jsonl", found[i:i + 40])
    columns = ["device", "poll", "seq", "seq_after", "read_ok", "origin", "text"]
    want = sorted(map(tuple, batch_feed.change_feed(rows).collect()))
    landed = polls.readable(polls.read_polls(spark, root))
    assert sorted(map(str, landed.select(columns).collect())) == sorted(map(str, rows.select(columns).collect()))
    assert sorted(map(tuple, batch_feed.change_feed(landed).collect())) == want
    got = _run(spark, timers.change_feed(polls.readable(polls.stream_polls(spark, root)), clock=None), "s7_feed")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("limit", [None, 2])
def test_available_now_goes_on_where_it_ended(spark, limit):
    root, checkpoint, log = folder("polls"), folder("chk"), Log()
    landed = 0
    for run in range(4):
        for n in range(landed + 1, landed + 4 if run < 2 else landed + 1):
            land(root, 1, f"{n:04d}.jsonl", [poll(n)])
        landed += 3 if run < 2 else 0
        q = (polls.stream_polls(spark, root, limit).writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        assert q.awaitTermination(60)
        assert log.all() == [(1, n) for n in range(1, (landed if limit is None else min(landed, 2 * (run + 1))) + 1)]
    assert len(log.all()) == 6
