"""Emissions at a distance: blocks, runs of blocks and ties against a loop over the rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_feed import brute_batches, brute_taps
from transloom.operators import feed
from transloom.operators.spacing import Chains, block_entries, spaced, with_entries


def plain(ts, interval):
    out, last = [], None
    for i, t in enumerate(ts):
        if last is None or t - last >= interval:
            out.append(i)
            last = t
    return out


def test_chains_of_blocks():
    rng = random.Random(7)
    for _ in range(300):
        interval, blocks = rng.randint(1, 12), [sorted(rng.randint(0, 60) for _ in range(rng.randint(1, 25))) for _ in range(4)]
        t, start = np.concatenate(blocks), np.cumsum([0] + [len(b) for b in blocks[:-1]])
        chains = Chains(t, start, interval)
        entry = np.array([b[0] - rng.randint(0, interval + 3) for b in blocks])
        free = np.array([rng.random() < 0.3 for _ in blocks])
        want = []
        for s, b, e, f in zip(start, blocks, entry, free):
            first = next((i for i, x in enumerate(b) if f or x - e >= interval), len(b))
            want += [s + first + i for i in plain(b[first:], interval)]
        assert np.flatnonzero(chains.reached(chains.first(entry, free))).tolist() == want
        last, count = chains.ends()
        for s, b in zip(start, blocks):
            for i in range(len(b)):
                chain = plain(b[i:], interval)
                assert (last[s + i], count[s + i]) == (s + i + chain[-1], len(chain))


@pytest.mark.parametrize("block,fanout", [(1 << 20, 8), (64, 3), (10, 2), (1, 4)])
def test_delta_batches_over_blocks(spark, block, fanout):
    """Replies over many blocks, long silences, many deltas at one time, NULL deltas, a NULL id."""
    rng = random.Random(9)
    rows, want = [], {}
    for r in range(14):
        t, ts, name = 0, [], None if r == 13 else f"r{r}"
        for s in range(rng.randint(1, 60)):
            t += rng.choice([0, 0, 1, 3, 20, 40, 400 if r % 3 else 2])
            ts.append(t)
            rows.append((name, s, t, None if s % 11 == 10 else f"w{s} "))
        texts = ["" if i % 11 == 10 else f"w{i} " for i in range(len(ts))]
        want[name] = [(k, b[0], len(b), "".join(texts[i] for i in b)) for k, b in enumerate(brute_batches(ts))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "request_id string, seq long, t_ms long, delta string")
    got = {}
    for r in feed.delta_batches(df, block=block, fanout=fanout).orderBy("request_id", "batch_no").collect():
        got.setdefault(r.request_id, []).append((r.batch_no, r.first_seq, r.n_deltas, r.text))
    assert got == want


def test_one_long_reply_takes_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("request_id"), F.col("id").alias("seq"),
                               (F.col("id") * 7 + F.col("id") % 5).alias("t_ms"), F.lit("x").alias("delta"))
    out = feed.delta_batches(df, block=1 << 13, fanout=16)
    want = brute_batches([7 * i + i % 5 for i in range(n)])
    got = out.orderBy("batch_no").collect()
    assert [(r.batch_no, r.first_seq, r.n_deltas) for r in got] == [(k, b[0], len(b)) for k, b in enumerate(want)]
    dealt = with_entries(df, ["request_id"], "t_ms", "seq", 35, 1 << 13, True, 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would go to one task
    try:
        tasks = dealt.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < n / 4
    entries = block_entries(df, ["request_id"], "t_ms", "seq", 35, 1 << 13, 16).orderBy("_blk").collect()
    assert len(entries) == 171 and entries[0]._entry is None and entries[-1]._base < len(want)


def test_spaced_rows_keep_their_columns(spark):
    rows = [("a", 0, 1, "first"), ("a", 5, 2, "near"), ("a", 10, 3, "out"), ("b", 3, 1, "first"), (None, 3, 1, "first"), (None, 4, 2, "near")]
    df = spark.createDataFrame(rows, "k string, t long, n long, what string")
    for block in (1, 1000):
        assert {(r.k, r.n) for r in spaced(df, ["k"], "t", "n", 10, block).collect()} == {("a", 1), ("a", 3), ("b", 1), (None, 1)}


@pytest.mark.parametrize("block,fanout", [(1 << 20, 8), (700, 3), (60, 4)])
def test_one_long_run_of_taps(spark, block, fanout):
    """A user who never pauses: taps that pair, that are too near, too long, or broken by another key."""
    rng = random.Random(21)
    rows, events, t = [], [], 0
    presses = []
    for _ in range(600):
        t += rng.choice([45, 60, 90, 130, 300, 480])
        presses.append(t)
    for i, t in enumerate(presses):
        key = "other" if rng.random() < 0.1 else "ctrl"
        hold = min(rng.choice([5, 30, 80, 510]), (presses[i + 1] if i + 1 < len(presses) else t + 99) - t - 1)
        rows.append((1, key, t, t + hold))
        events.append((t, 0 if key == "ctrl" else 2))
        if key == "ctrl":
            events.append((t + hold, 1))
    df = spark.createDataFrame(rows, "user_id long, key string, press_ms long, release_ms long")
    got = sorted(r.fire_ms for r in feed.paired_events(df, block=block, fanout=fanout).collect())
    assert got == brute_taps(events) and len(got) > 50


def test_another_key_at_a_border_of_presses(spark):
    """Another key at the time of the press or just before the release spoils a tap, at the release it does not."""
    def taps(at):
        return [(1, "ctrl", 100, 150), (1, "ctrl", 200, 250), (1, "other", at, at + 1)]
    for at, fires in ((200, []), (249, []), (250, [250]), (199, []), (150, []), (99, [250])):
        for block in (10, 1000):
            df = spark.createDataFrame(taps(at), "user_id long, key string, press_ms long, release_ms long")
            assert [r.fire_ms for r in feed.paired_events(df, block=block).collect()] == fires, at
