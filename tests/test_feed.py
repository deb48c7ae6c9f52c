import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from transloom.operators import feed
from transloom.operators.ordering import keyed_lag, runs


def test_keyed_lag_equals_window_lag(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i * rng.randint(1, 3), rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v int").dropDuplicates(["k", "o"])
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    for block in (1, 7, 50, 10_000):
        got = keyed_lag(df, ["k"], "o", ["v"], block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), block


def test_runs_split_at_gaps_only(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in "abc":
        t, prev, run = 0, None, None
        for _ in range(120):
            t += rng.choice([1, 2, 5, 30])
            run = t if prev is None or t - prev > 10 else run
            want[k, t], prev = run, t
            rows.append((k, t))
    df = spark.createDataFrame(rows, "k string, t long")
    for block in (1, 7, 50, 10_000):
        assert {(r.k, r.t): r.run for r in runs(df, ["k"], "t", "t", 10, block).collect()} == want, block


def brute_batches(ts, interval=35):
    batches, pending, last = [], [], None
    for i, t in enumerate(ts):
        pending.append(i)
        if last is None or t - last >= interval:
            batches.append(pending)
            pending, last = [], t
    if pending:
        batches.append(pending)
    return batches


def test_delta_batches_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for r in range(40):
        t, ts = 0, []
        for s in range(rng.randint(1, 30)):
            t += rng.randint(1, 40)
            ts.append(t)
            rows.append((f"r{r}", s, t, f"w{s} "))
        want[f"r{r}"] = [("".join(f"w{i} " for i in b), len(b)) for b in brute_batches(ts)]
    df = spark.createDataFrame(rows, "request_id string, seq long, t_ms long, delta string")
    got = {}
    for row in feed.delta_batches(df).orderBy("request_id", "batch_no").collect():
        got.setdefault(row.request_id, []).append((row.text, row.n_deltas))
    assert got == want


def brute_taps(events, min_gap=40, max_gap=500, max_hold=500, refractory=250):
    """Sequential state machine over (t, kind) with kind 0=modifier down, 1=up, 2=other key down."""
    down, chord, last_tap, last_fire, fires = None, False, None, None, []
    for t, kind in sorted(events):
        if kind == 2:
            last_tap = None
            if down is not None:
                chord = True
        elif kind == 0:
            if down is None:
                down, chord = t, False
        else:
            if down is None:
                continue
            hold, down = t - down, None
            if chord:
                chord, last_tap = False, None
            elif hold > max_hold:
                last_tap = None
            elif last_tap is not None and min_gap <= t - last_tap <= max_gap:
                last_tap = None
                if last_fire is None or t - last_fire >= refractory:
                    fires.append(t)
                    last_fire = t
            else:
                last_tap = t
    return fires


def test_paired_events_brute_force(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for u in range(30):
        t, events, presses = 0, [], []
        for _ in range(rng.randint(2, 40)):
            t += rng.choice([rng.randint(30, 300), rng.randint(300, 900)])
            presses.append(t)
        for i, t in enumerate(presses):
            key = "other" if rng.random() < 0.15 else "ctrl"
            hold = rng.randint(20, 600)
            if i + 1 < len(presses):  # a key cannot go down again while held
                hold = min(hold, presses[i + 1] - t - 1)
            rows.append((u, key, t, t + hold))
            events.append((t, 0 if key == "ctrl" else 2))
            if key == "ctrl":
                events.append((t + hold, 1))
        want[u] = brute_taps(events)
    df = spark.createDataFrame(rows, "user_id long, key string, press_ms long, release_ms long")
    for block in (100, 1 << 22):
        got = {}
        for r in feed.paired_events(df, block=block).collect():
            got.setdefault(r.user_id, []).append(r.fire_ms)
        assert {u: sorted(v) for u, v in got.items()} == {u: v for u, v in want.items() if v}, block


def test_change_feed_rules(spark):
    rows = [(1, 1, 5, 5, True, "user", "baseline"), (1, 2, 5, 5, True, "user", "same"),
            (1, 3, 0, 0, True, "user", "zero"), (1, 4, 6, 6, False, "user", "failed"),
            (1, 5, 6, 7, True, "user", "torn"), (1, 6, 7, 7, True, "user", "fires"),
            (1, 7, 8, 8, True, "self", "own"), (1, 8, 9, 9, True, "user", "  "), (1, 9, 9, 9, True, "user", "again"),
            (1, 10, 10, 10, True, "user", "last")]
    df = spark.createDataFrame(rows, "device long, poll long, seq long, seq_after long, read_ok boolean, "
                                     "origin string, text string")
    for block in (2, 1 << 22):
        got = [r.text for r in feed.change_feed(df, block).orderBy("poll").collect()]
        assert got == ["fires", "last"], block


def test_stable_input_rules(spark):
    rows = [(1, 1, "auto", "en", "zh", "a"), (1, 2, "auto", "en", "zh", "a"), (1, 3, "manual", "en", "zh", "a"),
            (1, 4, "auto", "en", "zh", " "), (1, 5, "auto", "en", "ja", "a"), (1, 6, "auto", "en", "ja", "a ")]
    df = spark.createDataFrame(rows, "user_id long, n long, trigger string, source string, target string, text string")
    got = [r.decision for r in feed.stable_input(df).orderBy("n").collect()]
    assert got == ["started", "skipped", "started", "blank", "started", "skipped"]
