import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from transloom.functions import tokens as TK
from transloom.operators import repair

# The reference's literal cases: (ids, source token count) -> expected
CASES = [
    ([5359] * 5, 1, [5359]),
    ([7, 8, 9, 8, 9, 8, 9], 1, [7, 8, 9]),
    ([4, 5, 4, 5, 4, 5], 3, [4, 5, 4, 5, 4, 5]),
    ([12, 12], 1, [12, 12]),
]


def brute_collapse(ids, src, k=3):
    """Straightforward search: every period, count whole trailing repeats."""
    n = len(ids)
    if n < max(4, 4 * src):
        return ids
    for p in range(1, n // k + 1):
        unit = ids[n - p:]
        reps, start = 1, n - p
        while start >= p and ids[start - p:start] == unit:
            reps += 1
            start -= p
        if reps >= k:
            return ids[:start] + unit
    return ids


def test_python_collapse_reference_cases():
    for ids, src, want in CASES:
        assert repair.collapse_repetition(ids, src) == want


def test_sql_collapse_reference_cases(spark):
    df = spark.createDataFrame([(ids, src) for ids, src, _ in CASES], "ids array<int>, src int")
    out = TK.collapse_repetition_df(df, "ids", F.col("src"), "out").select("out").collect()
    assert [r.out for r in out] == [w for _, _, w in CASES]
    out2 = df.select(TK.collapse_repetition("ids", F.col("src")).alias("o")).collect()
    assert [r.o for r in out2] == [w for _, _, w in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 3))
def test_python_collapse_matches_brute_force(ids, src):
    assert repair.collapse_repetition(ids, src) == brute_collapse(ids, src)


def test_sql_collapse_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        n = rng.randint(0, 40)
        unit = [rng.randint(0, 3) for _ in range(rng.randint(1, 5))]
        head = [rng.randint(0, 3) for _ in range(rng.randint(0, 8))]
        ids = (head + unit * rng.randint(1, 6))[:n] if rng.random() < 0.7 else [rng.randint(0, 2) for _ in range(n)]
        rows.append((ids, rng.randint(1, 2)))
    df = spark.createDataFrame(rows, "ids array<int>, src int")
    got = TK.collapse_repetition_df(df, "ids", F.col("src"), "out").collect()
    for r in got:
        assert r.out == brute_collapse(list(r.ids), r.src), (r.ids, r.src)


def test_collapse_idempotent():
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randint(0, 2) for _ in range(rng.randint(0, 30))]
        once = repair.collapse_repetition(ids, 1)
        assert repair.collapse_repetition(once, 1) == repair.collapse_repetition(once, 1)


def test_strip_special(spark):
    special = {0, 2}
    cases = [[0, 2, 5, 0, 6, 2], [0, 2], [], [7]]
    assert [repair.strip_special(c, special) for c in cases] == [[5, 0, 6], [], [], [7]]
    df = spark.createDataFrame([(c,) for c in cases], "ids array<int>")
    out = df.select(TK.strip_special("ids", F.array(F.lit(0), F.lit(2))).alias("o")).collect()
    assert [r.o for r in out] == [[5, 0, 6], [], [], [7]]


def test_chunks_and_budget(spark):
    df = spark.createDataFrame([(list(range(900)),), ([],)], "a array<int>")
    out = df.select(TK.chunk_array("a", 420).alias("c")).collect()
    assert [len(x) for x in out[0].c] == [420, 420, 60]
    assert out[1].c == []
    b = spark.createDataFrame([(1,), (5,), (200,)], "n int").select(TK.generation_budget("n").alias("b")).collect()
    assert [r.b for r in b] == [32, 36, 512]
