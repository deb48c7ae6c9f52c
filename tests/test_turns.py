"""One translation at a time, the feed before typed input."""
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_streaming import _files, _run, _stream
from transloom.operators.turns import Turn, _Followed, _Lasts, _through, settled, step, turns
from transloom.sources import fixtures as fx
from transloom.sources.tables import table
from transloom.streaming import stateful

ROWS = "user_id long, n long, kind string, source string, target string, text string"


def started(spark, *rows):
    """rows: (kind, text) or (kind, text, target); what starts, as (n, started, origin, text)."""
    full = [(1, i, r[0], "en", r[2] if len(r) > 2 else "zh", r[1]) for i, r in enumerate(rows)]
    return [(r.n, r.started, r.origin, r.text) for r in turns(spark.createDataFrame(full, ROWS)).orderBy("started").collect()]


@pytest.mark.parametrize("rows,want", [
    # the newest feed text wins over older ones and over typed text, which is no longer in the box afterwards
    ([("feed", "a"), ("feed", "b"), ("typed", "t"), ("feed", " c "), ("done", None), ("done", None)],
     [(0, 0, "feed", "a"), (3, 4, "feed", "c")]),
    # typed text waits and runs, if it is still in the box
    ([("feed", "a"), ("typed", "t"), ("done", None), ("done", None)], [(0, 0, "feed", "a"), (1, 2, "typed", "t")]),
    # the box was emptied, or holds another text that equals the running one
    ([("feed", "a"), ("typed", "t"), ("typed", " "), ("done", None)], [(0, 0, "feed", "a")]),
    ([("feed", "a"), ("typed", "t"), ("typed", "a"), ("done", None)], [(0, 0, "feed", "a")]),
    # the languages changed under it
    ([("feed", "a"), ("typed", "t"), ("feed", "", "ja"), ("done", None)], [(0, 0, "feed", "a"), (1, 3, "typed", "t")]),
    ([("feed", "a"), ("typed", "t"), ("typed", "t", "ja"), ("done", None)], [(0, 0, "feed", "a"), (2, 3, "typed", "t")]),
    # typed text that equals the last one started is not run again; feed text is
    ([("typed", "t"), ("done", None), ("typed", "t"), ("feed", "t")], [(0, 0, "typed", "t"), (3, 3, "feed", "t")]),
    # pending typed text outlives the feed text that came first, if it is typed again meanwhile
    ([("typed", "x"), ("typed", "t"), ("feed", "f"), ("done", None), ("typed", "t"), ("done", None)],
     [(0, 0, "typed", "x"), (2, 3, "feed", "f"), (4, 5, "typed", "t")]),
    ([("done", None), ("feed", None), ("typed", "t")], [(2, 2, "typed", "t")]),
])
def test_rules(spark, rows, want):
    assert started(spark, *rows) == want


def test_stream_equals_batch(spark):
    rows = fx.turn_rows(table(spark, SF_SMALL, "events")).orderBy("n")
    root, schema = _files(spark, rows, 3)
    got = _run(spark, stateful.turns(_stream(spark, root, schema, 3)), "t3_turns")
    want = sorted(map(tuple, turns(rows).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert {r[3] for r in want} == {"feed", "typed"} and any(r[1] != r[2] for r in want)


def random_rows(rng, n):
    """Rows of one user with stretches of one kind, repeated texts, blanks and other languages."""
    out = []
    while len(out) < n:
        kinds = rng.choice([["feed", "typed", "done"], ["typed"], ["typed", "done"], ["feed"], ["done"], ["feed", "done"]])
        for _ in range(rng.randint(1, 12)):
            out.append((rng.choice(kinds), rng.choice("en de".split()), rng.choice(["zh"] * 4 + ["ja"]), rng.choice(["a", "b", " ", "c", None])))
    return out[:n]


def plain(rows):
    state, out = Turn(), []
    for i, (kind, source, target, text) in enumerate(rows):
        state, started = step(state, i, kind, source, target, (text or "").strip())
        out += [started] if started else []
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17])
def test_blocks_equal_one_walk(size):
    rng = random.Random(size)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(1, 60))
        clean = [(i, k, s, t, (x or "").strip()) for i, (k, s, t, x) in enumerate(rows)]
        state, before, walked = Turn(), _Lasts(), Turn()
        for i in range(0, len(clean), size):
            block = _Followed(before)
            seen = _Lasts(before.feed, before.typed, before.languages)
            for row in clean[i:i + size]:
                block.see(*row)
                seen.see(*row)
                state = step(state, *row)[0]
            walked = _through(walked, json.loads(block.summary()))
            assert walked == settled(state), (rows, i)
            before = seen


def test_settled_states_behave_alike():
    rng = random.Random(8)
    for _ in range(500):
        rows = random_rows(rng, 40)
        state, out = Turn(), []
        for i, (kind, source, target, text) in enumerate(rows):
            state, started = step(settled(state), i, kind, source, target, (text or "").strip())
            out += [started] if started else []
        assert out == plain(rows)


@pytest.mark.parametrize("block_rows,base", [(3, 0), (50, 1 << 60), (100_000, 0)])
def test_users_of_many_rows_are_split(spark, block_rows, base):
    rng = random.Random(5)
    full, want = [], []
    for user, n in ((1, 400), (2, 3), (3, 40), (4, 1)):
        rows = random_rows(rng, n)
        if user == 3:
            rows = [(rng.choice(["feed", "typed"]), s, t, x) for _, s, t, x in rows]  # nothing is ever done
        full += [(user, base + i * i, *r) for i, r in enumerate(rows)]
        want += [(user, base + a * a, base + b * b, *r) for a, b, *r in plain(rows)]
    rng.shuffle(full)
    df = spark.createDataFrame([*full, (None, 1, "feed", "en", "zh", "x")], ROWS).withColumn("text_of", F.lit(1))
    assert sorted(map(tuple, turns(df, block_rows).collect())) == sorted(want)


def test_split_equals_whole_on_the_tables(spark):
    rows = fx.turn_rows(table(spark, SF_SMALL, "events"))
    assert sorted(map(tuple, turns(rows, 4).collect())) == sorted(map(tuple, turns(rows).collect()))


def test_one_user_takes_many_tasks(spark):
    """Rows of one user leave their exchange by user and block; only a row a block is dealt by user."""
    df = spark.range(2000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("n"), F.lit("feed").alias("kind"),
                                  F.lit("en").alias("source"), F.lit("zh").alias("target"), F.lit("t").alias("text"))
    found = turns(df, 100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id#" in plan
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert sum("_blk" in line for line in dealt) == 1 and len(dealt) == 3  # short users, blocks' rows, a row a block
    assert found.count() == 1
