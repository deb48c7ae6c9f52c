import datetime
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from transloom.functions.text import GO_SPACE
from transloom.operators import feed as batch_feed
from transloom.plans.corpus import RESULT_COLUMNS, translate_corpus
from transloom.sources import fixtures as fx
from transloom.sources.tables import table
from transloom.operators.memory import MemoryTable
from transloom.streaming import batches, snapshots, stateful, timers


def _files(spark, df, n_files):
    """Write ``df`` as ``n_files`` Parquet files (one micro-batch each) and return the folder."""
    root = tempfile.mkdtemp(prefix="transloom-stream-")
    pdf = df.toPandas()
    chunks = [pdf.iloc[len(pdf) * i // n_files: len(pdf) * (i + 1) // n_files] for i in range(n_files)]
    for i, c in enumerate(chunks):
        spark.createDataFrame(c, df.schema).coalesce(1).write.parquet(os.path.join(root, f"part{i}"))
    return root, df.schema


def _finish(q):
    # a stateful query with a timeout keeps running empty batches; stop once all input is in
    q.processAllAvailable()
    q.stop()


def _run(spark, stream_df, name, output_mode="append"):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(output_mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="transloom-chk-"))
         .trigger(availableNow=True).start())
    _finish(q)
    return spark.table(name)


def _stream(spark, root, schema, n_files):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(root))


def test_coalesce_stream_equals_batch_twin(spark):
    deltas = fx.deltas(table(spark, SF_SMALL, "documents")).where(F.col("request_id").isin("d0", "d1", "d2", "d5"))
    ends = deltas.groupBy("request_id").agg((F.max("seq") + 1).alias("seq"), (F.max("t_ms") + 1).alias("t_ms")) \
        .select("request_id", "seq", "t_ms", F.lit("end").alias("kind"), F.lit(None).cast("string").alias("delta"))
    rows = deltas.select("request_id", "seq", "t_ms", F.lit("delta").alias("kind"), "delta").unionByName(ends)
    rows = rows.orderBy("seq")  # arrival order: early sequence numbers land in earlier files
    root, schema = _files(spark, rows, 3)
    got = _run(spark, timers.coalesce_deltas(_stream(spark, root, schema, 3), flush=False, clock=None), "t1_out")
    stream_texts = {}
    for r in got.orderBy("request_id", "emit_ms").collect():
        stream_texts.setdefault(r.request_id, []).append(r.text)
    batch = batch_feed.delta_batches(deltas).orderBy("request_id", "batch_no").collect()
    batch_texts = {}
    for r in batch:
        batch_texts.setdefault(r.request_id, []).append(r.text)
    assert stream_texts == batch_texts


def test_change_feed_stream_equals_batch_twin(spark):
    polls = fx.feed(table(spark, SF_SMALL, "events")).drop("ts").orderBy("poll")
    root, schema = _files(spark, polls, 3)
    got = _run(spark, timers.change_feed(_stream(spark, root, schema, 3), clock=None), "t2_out")
    want = batch_feed.change_feed(polls)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_wins_and_status_upsert_sinks(spark):
    polls = fx.feed(table(spark, SF_SMALL, "events")).drop("ts")
    root, schema = _files(spark, polls, 2)
    out = tempfile.mkdtemp(prefix="transloom-t3-")
    q = (_stream(spark, root, schema, 2).writeStream.foreachBatch(batches.write_latest_wins(out))
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    _finish(q)
    want = []
    for i in range(2):  # one trigger a file: the last text that is not blank, and how many it replaces
        live = {}
        for r in sorted(spark.read.parquet(os.path.join(root, f"part{i}")).collect(), key=lambda r: r.poll):
            if r.text.strip(GO_SPACE):
                live.setdefault(r.device, []).append(r)
        want += [(device, rows[-1].poll, rows[-1].text.strip(GO_SPACE), len(rows) - 1) for device, rows in live.items()]
    got = spark.read.parquet(out).select("device", "poll", "text", "n_superseded").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(n for *_, n in want)

    status = spark.createDataFrame(
        [("m1", 1, "downloading", "a", 10), ("m1", 5, "downloading", "b", 50), ("m2", 2, "downloading", "c", -1),
         ("m1", 9, "ready", "d", 100)], "model string, n long, status string, message string, progress int")
    sroot, sschema = _files(spark, status, 2)
    table_root = tempfile.mkdtemp(prefix="transloom-t5-")
    q = (_stream(spark, sroot, sschema, 2).writeStream.foreachBatch(snapshots.upsert_latest_status(table_root))
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    _finish(q)
    snap = {r.model: (r.status, r.progress) for r in snapshots.status_table(spark, table_root).read().collect()}
    assert snap == {"m1": ("ready", 100), "m2": ("downloading", -1)}


def test_continuous_translation_fills_memory(spark):
    docs = table(spark, SF_SMALL, "documents").limit(30)
    req = fx.requests(docs)
    root, schema = _files(spark, req, 2)
    settings = fx.settings(table(spark, SF_SMALL, "documents"))
    base = tempfile.mkdtemp(prefix="transloom-t7-")
    sink = batches.continuous_translation(settings, os.path.join(base, "results"), os.path.join(base, "memory"))
    q = (_stream(spark, root, schema, 2).writeStream.foreachBatch(sink)
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    _finish(q)
    results = spark.read.parquet(os.path.join(base, "results"))
    sent = spark.read.option("recursiveFileLookup", "true").parquet(root)
    want = translate_corpus(sent, settings)
    assert sorted(map(str, results.select(*RESULT_COLUMNS).collect())) == sorted(map(str, want.collect()))
    assert MemoryTable(spark, os.path.join(base, "memory")).rows().count() > 0


def test_stable_input_stream_equals_batch_twin(spark):
    typed = fx.typed_input(table(spark, SF_SMALL, "events")).orderBy("n")
    root, schema = _files(spark, typed, 3)
    got = _run(spark, stateful.stable_input(_stream(spark, root, schema, 3)), "t4_consecutive")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_feed.stable_input(typed).collect()))


def test_paired_events_stream_equals_batch_twin(spark):
    taps = fx.taps(table(spark, SF_SMALL, "events")).orderBy("press_ms")
    root, schema = _files(spark, taps, 3)
    got = _run(spark, stateful.paired_events(_stream(spark, root, schema, 3)), "t6_out")
    want = sorted(map(tuple, batch_feed.paired_events(taps).collect()))
    assert sorted(map(tuple, got.collect())) == want and want


def test_replayed_translation_batch_keeps_one_memory_row(spark):
    req = fx.requests(table(spark, SF_SMALL, "documents").limit(20))
    settings = fx.settings(table(spark, SF_SMALL, "documents"))
    base = tempfile.mkdtemp(prefix="transloom-replay-")
    sink = batches.continuous_translation(settings, os.path.join(base, "results"), os.path.join(base, "memory"))
    sink(req, 0)
    first = MemoryTable(spark, os.path.join(base, "memory")).rows().count()
    sink(req, 0)
    assert MemoryTable(spark, os.path.join(base, "memory")).rows().count() == first > 0


def test_duplicate_suppression_runs(spark):
    rows = spark.createDataFrame(
        [("a", datetime.datetime(2024, 1, 1, 0, 0, 0)), ("a", datetime.datetime(2024, 1, 1, 0, 0, 1)),
         ("b", datetime.datetime(2024, 1, 1, 0, 0, 2))], "text string, ts timestamp")
    root, schema = _files(spark, rows, 1)
    got = _run(spark, batches.suppress_duplicates(_stream(spark, root, schema, 1), ["text"], "ts"), "t4_out")
    assert sorted(r.text for r in got.collect()) == ["a", "b"]
