"""Streams with timers, outer joins and counters: stream equals batch, however the rows fall into micro-batches."""
import datetime
import os
import random
import tempfile
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_streaming import _files, _run, _stream
from transloom import constants as K
from transloom.operators import audit
from transloom.operators import feed as batch_feed
from transloom.plans import catalog
from transloom.plans.corpus import audit_rows
from transloom.sources import fixtures as fx
from transloom.sources.tables import table
from transloom.streaming import replies, timers
from transloom.streaming.metrics import StreamCounts

DELTAS = "request_id string, seq long, t_ms long, kind string, delta string"
POLLS = "device long, poll long, seq long, seq_after long, read_ok boolean, origin string, text string, ts timestamp"
DAY = datetime.datetime(2024, 1, 1)


def plain_flushes(rows, interval=35):
    """Emissions of one reply when pending text leaves ``interval`` after the last emission."""
    out, held, last = [], "", None
    for t, kind, delta in rows:
        if held and t > last + interval:
            last += interval
            out.append((last, held))
            held = ""
        if kind == "delta":
            held += delta
            if last is None or t - last >= interval:
                out.append((t, held))
                held, last = "", t
        else:
            if kind == "end" and held:
                out.append((t, held))
            held, last = "", None
    if held:
        out.append((last + interval, held))
    return out


def run_counted(spark, stream, name):
    counts = StreamCounts()
    spark.streams.addListener(counts)
    try:
        q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", tempfile.mkdtemp(prefix="transloom-chk-")).trigger(availableNow=True).start())
        q.awaitTermination(120)
        for _ in range(100):
            if counts.of(q).get("batches", 0) >= len(q.recentProgress):
                break
            time.sleep(0.1)
        return spark.table(name), counts.of(q)
    finally:
        spark.streams.removeListener(counts)


@pytest.mark.parametrize("files", [1, 4])
def test_pending_deltas_leave_by_time(spark, files):
    rng = random.Random(3)
    rows, want = [], []
    for r in range(12):
        t, one = 1_000_000, []
        for s in range(rng.randint(1, 25)):
            t += rng.choice([0, 4, 9, 20, 35, 36, 90])
            one.append((t, "delta", f"w{s} "))
        if r % 3:
            one.append((t + 3, "end" if r % 3 == 1 else "error", None))
        rows += [(f"r{r}", s, *row) for s, row in enumerate(one)]
        want += [(f"r{r}", *e) for e in plain_flushes(one)]
    rows.append(("clock", 0, 9_000_000, "delta", "moves the watermark"))
    rows.append(("clock", 1, 9_900_000, "end", None))
    want.append(("clock", 9_000_000, "moves the watermark"))
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), DELTAS)
    root, schema = _files(spark, df, files)
    got = _run(spark, timers.coalesce_deltas(_stream(spark, root, schema, files)), f"t1_flush_{files}")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_error_drops_pending(spark):
    rows = spark.createDataFrame([("r", 0, 1000, "delta", "a"), ("r", 1, 1010, "delta", "b"), ("r", 2, 1020, "error", None)], DELTAS)
    root, schema = _files(spark, rows, 1)
    got = _run(spark, timers.coalesce_deltas(_stream(spark, root, schema, 1)), "t1_err")
    assert [r.text for r in got.collect()] == ["a"]


def test_pending_deltas_leave_by_the_machines_clock(spark):
    rows = spark.createDataFrame([("r", 0, 0, "delta", "a"), ("r", 1, 10, "delta", "b")], DELTAS)
    root, schema = _files(spark, rows, 1)
    out = timers.coalesce_deltas(_stream(spark, root, schema, 1), clock="processing")
    q = (out.writeStream.format("memory").queryName("t1_clock").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="transloom-chk-")).trigger(processingTime="200 milliseconds").start())
    try:
        for _ in range(300):
            if spark.table("t1_clock").count() == 2:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("t1_clock").orderBy("emit_ms").collect()] == [("r", 0, "a"), ("r", 35, "b")]


def polls(*rows):
    return [(d, p, s, s, True, "user", text, DAY + datetime.timedelta(hours=h)) for d, p, s, text, h in rows]


def poll_stream(spark, *parts):
    root = tempfile.mkdtemp(prefix="transloom-polls-")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, POLLS).coalesce(1).write.parquet(os.path.join(root, f"part{i}"))
        time.sleep(0.01)
    return _stream(spark, root, spark.createDataFrame([], POLLS).schema, len(parts))


def test_state_expires_by_default_and_late_rows_are_counted(spark):
    stream = poll_stream(
        spark, polls((1, 1, 5, "baseline", 0), (1, 2, 6, "fires", 0.05)), polls((2, 3, 1, "moves the watermark", 90)),
        polls((2, 4, 2, "fires", 90.1)), polls((2, 5, 9, "late", 3)), polls((1, 6, 7, "a baseline again", 90.2), (1, 7, 8, "fires", 90.3)))
    got, counts = run_counted(spark, timers.change_feed(stream), "t2_late")
    assert sorted(r.poll for r in got.collect()) == [2, 4, 7]
    assert counts["late_rows"] == 1 and counts["input_rows"] == 7


def test_devices_go_on_from_a_batch_table(spark):
    past = spark.createDataFrame(polls((1, 1, 5, "old", 0), (1, 2, 6, "old", 0.01), (2, 3, 4, "old", 0)), POLLS)
    stream = poll_stream(spark, polls((1, 10, 6, "unchanged", 0.1), (2, 11, 5, "fires", 0.1), (3, 12, 9, "baseline", 0.1)))
    got = _run(spark, timers.change_feed(stream, baselines=timers.last_counters(past)), "t2_initial")
    assert [(r.device, r.poll) for r in got.collect()] == [(2, 11)]
    both = past.unionByName(spark.createDataFrame(polls((1, 10, 6, "unchanged", 0.1), (2, 11, 5, "fires", 0.1), (3, 12, 9, "b", 0.1)), POLLS))
    assert [r.poll for r in batch_feed.change_feed(both).where("poll >= 10").collect()] == [11]


def test_change_feed_with_event_time_equals_batch(spark):
    rows = fx.feed(table(spark, SF_SMALL, "events")).orderBy("poll")
    root, schema = _files(spark, rows, 3)
    got = _run(spark, timers.change_feed(_stream(spark, root, schema, 3), watermark="9000 days"), "t2_event")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_feed.change_feed(rows).collect()))


def test_replies_meet_their_requests(spark):
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    ok = '{"choices":[{"message":{"content":"done"}}]}'
    asked = [[("a", "m", at(0)), ("b", "m", at(0)), ("c", "m", at(1))], [("z", "m", at(60))], [("y", "m", at(120))], [("x", "m", at(121))]]
    landed = [[("a", 0, 200, "application/json", ok, at(1)), ("unknown", 0, 200, "application/json", ok, at(1)),
               ("b", 0, 200, "application/json", ok, at(3))],  # after b's two minutes
              [("z", 0, 500, "text/plain", "broken", at(61))], [("none", 0, 200, "", "", at(120))], [("c", 0, 200, "", ok, at(2))]]
    streams = []
    for kind, parts, schema in (("asked", asked, "request_id string, model string, asked_at timestamp"),
                                ("landed", landed, "request_id string, attempt long, http_status int, content_type string, body string, "
                                                   "landed_at timestamp")):
        root = tempfile.mkdtemp(prefix=f"transloom-{kind}-")
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(root, f"part{i}"))
            time.sleep(0.01)
        streams.append(_stream(spark, root, spark.createDataFrame([], schema).schema, len(parts)))
    got, counts = run_counted(spark, replies.correlate(*streams), "j5_stream")
    rows = got.collect()
    assert Counter((r.request_id, r.status) for r in rows if r.request_id not in "xy") == Counter(
        [("a", "REPLIED"), ("b", "NO_REPLY"), ("c", "NO_REPLY"), ("z", "REPLIED")])
    assert counts["late_rows"] == 1  # c's reply, two hours behind
    out = {r.request_id: (r.status, r.text, r.error) for r in replies.results(got).collect()}
    assert out["a"] == ("OK", "done", "") and out["b"] == ("NO_REPLY", "", K.MSG_NO_TRANSLATION) and out["z"][0] == "HTTP_ERROR"


def test_run_counts_are_observed_while_the_audit_is_written(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="transloom-audit-"), "audit")
    rows = audit_rows(catalog._results(spark, SF_SMALL, audit=True))
    counts = audit.append_audit(rows, path, "run-1")
    stored = spark.read.parquet(path)
    want = {r.status: r["count"] for r in stored.groupBy("status").count().collect()}
    assert {k: v for k, v in counts.items() if v and k not in ("n_requests", "n_chars")} == want
    assert counts["n_requests"] == stored.count() and counts["n_chars"] == stored.agg(F.sum("n_chars")).first()[0]


def test_observed_metrics_of_a_stream_add_up(spark):
    rows = fx.feed(table(spark, SF_SMALL, "events")).orderBy("poll")
    root, schema = _files(spark, rows, 4)
    stream = _stream(spark, root, schema, 4).observe("polls", F.count_if("read_ok").alias("whole"), F.count(F.lit(1)).alias("all"))
    _, counts = run_counted(spark, stream, "observed")
    assert counts["polls.all"] == counts["input_rows"] == rows.count() and counts["polls.whole"] == rows.where("read_ok").count()
    assert counts["batches"] == 4
