"""What streams leave on disk: the memory by bucket, the status log, committed events."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_streaming import _files, _stream
from transloom.operators import memory as tm
from transloom.operators import progress
from transloom.operators.segment import SEGMENT_KEYS
from transloom.sources import fixtures as fx
from transloom.sources.tables import table
from transloom.streaming import events, snapshots, timers

MEMORY = ", ".join(f"{c} string" for c in tm.MEMORY_COLUMNS)


def _folder(what):
    return tempfile.mkdtemp(prefix=f"transloom-{what}-")


def _rows(n, mark="t", start=0):
    return [("en", "zh", "m", f"segment {i}", f"{mark} {i}") for i in range(start, start + n)]


# --- M9: memory -----------------------------------------------------------------------------------
def test_a_run_reads_only_the_buckets_that_may_hold_its_segments(spark):
    table_ = tm.MemoryTable(spark, _folder("memory"), buckets=32, bits=1 << 15)
    table_.remember(spark.createDataFrame(_rows(2000), MEMORY), "first")
    few = spark.createDataFrame([r[:4] for r in _rows(3)] + [("en", "zh", "m", f"new {i}") for i in range(40)], ", ".join(f"{c} string" for c in SEGMENT_KEYS))
    buckets = table_.touched(few, table_.runs())
    homes = few.where(F.col("segment").startswith("segment")).select(table_._bucket().alias("b")).distinct().collect()
    assert {r.b for r in homes} <= set(buckets) and len(buckets) <= 8  # 43 segments have their homes in most of the 32 buckets
    found = table_.recall(few)
    got = {r.segment: r.translation for r in found.collect()}
    assert {k: v for k, v in got.items() if v} == {f"segment {i}": f"t {i}" for i in range(3)} and len(got) == 43
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_every_key_is_found_and_a_key_has_one_row(spark):
    table_ = tm.MemoryTable(spark, _folder("memory"), buckets=8, bits=1 << 15)
    table_.remember(spark.createDataFrame(_rows(500), MEMORY), "a")
    table_.remember(spark.createDataFrame(_rows(500, "later", 400), MEMORY), "b")
    keys = spark.createDataFrame([r[:4] for r in _rows(1000)], ", ".join(f"{c} string" for c in SEGMENT_KEYS))
    want = {f"segment {i}": None if i >= 900 else f"later {i}" if i >= 400 else f"t {i}" for i in range(1000)}
    want |= {f"segment {i}": min(f"t {i}", f"later {i}") for i in range(400, 500)}
    assert {r.segment: r.translation for r in table_.recall(keys).collect()} == want
    table_.remember(spark.createDataFrame(_rows(10, "again"), MEMORY), "a")  # a replayed run replaces its rows
    assert table_.rows().count() == 510
    into = table_.compact()
    assert table_.runs() == [into] and table_.rows().count() == 510
    table_.remember(spark.createDataFrame(_rows(10, "again"), MEMORY), "a")  # its rows are in the compacted run already
    assert table_.runs() == [into]
    table_.remember(spark.createDataFrame(_rows(1, "new", 5000), MEMORY), "c")
    assert table_.runs() == sorted([into, "c"]) and table_.rows().count() == 511


def test_recall_groups_what_was_asked_for_only(spark):
    """No exchange or grouping of the memory itself: one exchange a side of the join, the grouping shares it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unique = spark.createDataFrame([r[:4] for r in _rows(3)], ", ".join(f"{c} string" for c in SEGMENT_KEYS))
        plan = tm.recall(unique, spark.createDataFrame(_rows(50), MEMORY))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("Aggregate") < plan.index("Join") and "Aggregate" not in plan[plan.index("Join"):]


def test_an_empty_memory(spark):
    table_ = tm.MemoryTable(spark, _folder("memory"))
    unique = spark.createDataFrame([r[:4] for r in _rows(2)], ", ".join(f"{c} string" for c in SEGMENT_KEYS))
    assert table_.runs() == [] and table_.rows().count() == 0 and table_.compact() is None
    assert [r.translation for r in table_.recall(unique).collect()] == [None, None]


# --- M10: status log ------------------------------------------------------------------------------
STATUS = "model string, n long, status string, message string, progress int"


def test_a_trigger_writes_its_changes_only(spark):
    path = _folder("status")
    log = snapshots.status_table(spark, path, every=3)
    batches = [[("m1", 1, "downloading", "a", 1), ("m1", 2, "downloading", "b", 2), ("m2", 1, "downloading", "c", 0)],
               [("m1", 3, "ready", "d", 100)], [("m3", 9, "downloading", "e", 5)], [("m2", 7, "error", "f", 3)], [("m1", 1, "late", "g", 0)]]
    want = {}
    for i, rows in enumerate(batches):
        log.write(spark.createDataFrame(rows, STATUS), i)
        for r in rows:
            if r[1] >= want.get(r[0], r)[1]:
                want[r[0]] = r
        assert {r.model: tuple(r) for r in log.read().collect()} == want
        assert spark.read.parquet(f"{path}/delta/batch={i}").count() == len({r[0] for r in rows})
    assert log._parts(2) == ["base/version=2"] and log._parts(4) == ["base/version=2", "delta/batch=3", "delta/batch=4"]
    assert {r.model: r.status for r in log.read(0).collect()} == {"m1": "downloading", "m2": "downloading"}
    log.write(spark.createDataFrame(batches[4], STATUS), 4)  # a replay changes nothing
    assert {r.model: tuple(r) for r in log.read().collect()} == want


def test_a_status_log_does_not_go_on_without_its_past(spark):
    with pytest.raises(FileNotFoundError):
        snapshots.status_table(spark, _folder("status")).write(spark.createDataFrame([("m", 1, "s", "m", 1)], STATUS), 3)


def test_status_log_equals_batch(spark):
    status = progress.download_status(fx.progress_log(table(spark, SF_SMALL, "events"))).select(
        "model", "n", "status", "message", F.col("progress").cast("int")).orderBy("n")
    root, schema = _files(spark, status, 5)
    path = _folder("status")
    q = (_stream(spark, root, schema, 5).writeStream.foreachBatch(snapshots.upsert_latest_status(path, every=2))
         .option("checkpointLocation", _folder("chk")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    want = progress.latest_status(status.withColumn("log_id", F.lit("l")))
    got = snapshots.status_table(spark, path).read()
    assert sorted((r.model, r.n, r.message, r.progress) for r in got.collect()) == sorted(
        (r.model, r.updated_n, r.message, r.progress) for r in want.collect())


# --- M7: events -----------------------------------------------------------------------------------
def _write(spark, stream, root, chk):
    q = events.write_events(stream, root).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_topics_from_their_streams(spark):
    root = _folder("events")
    polls = fx.feed(table(spark, SF_SMALL, "events")).orderBy("poll")
    source, schema = _files(spark, polls, 2)
    _write(spark, events.clipboard_translate(timers.change_feed(_stream(spark, source, schema, 2), clock=None)), f"{root}/a", _folder("chk"))
    _write(spark, events.clipboard_error(_stream(spark, source, schema, 2)), f"{root}/b", _folder("chk"))
    from transloom.operators import feed
    want = sorted((str(r.device), r.poll) for r in feed.change_feed(polls).collect())
    assert sorted((r.key, r.ts) for r in events.read_events(spark, f"{root}/a").collect()) == want and want
    bad = polls.where(~F.col("read_ok") | (F.col("seq_after") != F.col("seq")))
    got = events.read_events(spark, f"{root}/b")
    assert got.count() == bad.count() > 0 and {r.topic for r in got.collect()} == {"clipboard-error"}

    deltas = spark.createDataFrame([("r", 0, 1000, "delta", "a"), ("r", 1, 1050, "delta", "é"), ("r", 2, 1051, "end", None)],
                                   "request_id string, seq long, t_ms long, kind string, delta string")
    source, schema = _files(spark, deltas, 1)
    _write(spark, events.translation_stream(timers.coalesce_deltas(_stream(spark, source, schema, 1))), f"{root}/c", _folder("chk"))
    assert sorted((r.key, r.payload, r.ts) for r in events.read_events(spark, f"{root}/c").collect()) == [
        ("r", '{"requestId":"r","delta":"a"}', 1000), ("r", '{"requestId":"r","delta":"é"}', 1050)]

    status = spark.createDataFrame([("m", 4, "downloading", "x", 7)], STATUS)
    source, schema = _files(spark, status, 1)
    _write(spark, events.model_download_status(_stream(spark, source, schema, 1)), f"{root}/d", _folder("chk"))
    assert [(r.topic, r.key, r.ts) for r in events.read_events(spark, f"{root}/d").collect()] == [("model-download-status", "m", 4)]


def test_a_killed_batch_leaves_no_half_event(spark):
    root = _folder("events")
    rows = spark.createDataFrame([(i, "boom" if i == 77 else "ok") for i in range(100)], "n long, text string")
    source, schema = _files(spark, rows, 1)

    @F.udf("string")
    def fails(text):
        if text == "boom":
            raise RuntimeError("killed")
        return text

    bad = events.event_rows(_stream(spark, source, schema, 1).repartition(4).withColumn("text", fails("text")), "t", "n", ["text"], "n")
    chk = _folder("chk")
    with pytest.raises(Exception, match="killed"):
        _write(spark, bad, root, chk)
    assert events.read_events(spark, root).count() == 0
    good = events.event_rows(_stream(spark, source, schema, 1).repartition(4), "t", "n", ["text"], "n")
    _write(spark, good, root, chk)  # the same trigger, run again
    assert sorted(int(r.key) for r in events.read_events(spark, root).collect()) == list(range(100))
    writer = events._Writer(root)
    left = len(os.listdir(f"{root}/data"))
    from pyspark.sql import Row
    staged = writer.write(iter([Row(topic="t", key="k", payload="{}", ts=1)]))
    assert len(os.listdir(f"{root}/data")) == left + 1
    writer.abort([staged, None], 5)
    assert len(os.listdir(f"{root}/data")) == left and events.read_events(spark, root).count() == 100
