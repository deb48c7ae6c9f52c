"""Emissions that keep a distance: the first row of a key goes out at once, then each first row that
comes ``interval`` or more after the last emission (W6, and the refractory period of T6).

When a row goes out depends on when the one before did, yet no key is walked row by row or by one task:

* Rows are in order of time, so a row's successor, the first row ``interval`` later, is one binary search. The
  emissions are the rows reachable from the first one; they are found by pointer doubling, in a number of array steps
  logarithmic in the chain's length.
* A key is cut into blocks of time, which different tasks take. What a block does depends on one number only: how
  long before its first row the last emission was, up to ``interval``. A block of a key that has several is a table
  of that: last emission and number of emissions for each of the ``interval + 1`` cases. Tables are composed over runs of
  ``FANOUT`` blocks, then over the runs of a key; what comes out is each block's entry (last emission, emissions so far).
  A key of 10^12 rows has about as many tables as its longest group has rows.
* Most keys fit one block. Those are told apart by their first and last block (one narrow aggregate, run while the plan
  is built) and need no table.

Times are whole numbers; rows of one time are in order of ``tie``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.session import ship_package, stored

FANOUT = 1024


def long_keys(rows: DataFrame, keys: list[str], t: str, block: int) -> DataFrame:
    """Keys whose rows lie in more than one block of time (stored, so that the planner knows how few they are)."""
    at = F.floor(F.col(t) / F.lit(block))
    span = rows.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return stored(span.where("_a < _b").select(*keys), "long-keys")


def split_keys(rows: DataFrame, long: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of keys of one block, rows of the long keys)."""
    other = long.select(*[F.col(k).alias(f"_long_{k}") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(other[f"_long_{k}"])
    return rows.join(other, cond, "left_anti"), rows.join(other, cond, "left_semi")


# ---------------------------------------------------------------------------
# one block
# ---------------------------------------------------------------------------
class Chains:
    """The rows of several blocks, each in order of time; ``start`` holds each block's first row."""

    def __init__(self, t: np.ndarray, start: np.ndarray, interval: int):
        self.n, self.start, self.interval = len(t), start, interval
        self.end = np.r_[start[1:], self.n]
        self.of = np.repeat(np.arange(len(start)), self.end - start)
        # blocks are laid out one after the other on one axis, further apart than an interval
        self.shift = np.arange(len(start)) * (int(t.max() - t.min()) + interval + 1) - int(t.min()) if self.n else np.zeros(0, np.int64)
        self.at, self.t = t + self.shift[self.of] if self.n else t, t
        after = np.searchsorted(self.at, self.at + interval)
        self.next = np.where(after < self.end[self.of], after, self.n) if self.n else after

    def first(self, entry: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Of each block, the first row to go out, if the last emission was at ``entry`` (``free``: there was none);
        the block's end if none does."""
        found = np.searchsorted(self.at, np.where(free, self.t[self.start], entry + self.interval) + self.shift)
        return np.clip(found, self.start, self.end)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row: the last emission and the number of emissions in its block, if the row goes out."""
        jump, steps = np.r_[self.next, self.n], np.r_[np.ones(self.n, np.int64), 0]
        last = np.where(jump < self.n, jump, np.arange(self.n + 1))
        while (jump[:-1] < self.n).any():
            steps, jump, last = steps + steps[jump], jump[jump], last[last]
        return last[:-1], steps[:-1]

    def reached(self, first: np.ndarray) -> np.ndarray:
        """Which rows go out, from each block's first one on."""
        jump, out = np.r_[self.next, self.n], np.zeros(self.n + 1, bool)
        out[np.where(first < self.end, first, self.n)] = True
        while True:
            there = jump[out.nonzero()[0]]
            out[there] = True
            if (jump[:-1] >= self.n).all():
                return out[:-1]
            jump = jump[jump]


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a column differs from the row before (null equals null)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), True)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.and_(differ, pc.invert(both)).to_numpy(zero_copy_only=False)


def _whole_blocks(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``by``: tables of whole blocks with each block's first row. A block that may go on in the next
    batch waits."""
    wait: list[pa.RecordBatch] = []

    def table(parts: list) -> tuple[pa.Table, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        new = np.zeros(max(whole.num_rows - 1, 0), bool)
        for name in by:
            new |= _changes(whole.column(name))
        return whole, np.r_[0, np.flatnonzero(new) + 1] if whole.num_rows else np.zeros(0, np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        if any(not batch.column(n).slice(batch.num_rows - 1).equals(wait[0].column(n).slice(0, 1)) for n in by):
            whole, start = table(wait)
            cut = int(start[-1])
            yield whole.slice(0, cut), start[:-1]
            wait = whole.slice(cut).to_batches()
    if wait:
        yield table(wait)


def _dealt(rows: DataFrame, keys: list[str], t: str, tie: str, block: int) -> DataFrame:
    d = rows.withColumn("_blk", F.floor(F.col(t) / F.lit(block)).cast("bigint"))
    return d.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", t, tie)


# ---------------------------------------------------------------------------
# entries of the blocks of long keys
# ---------------------------------------------------------------------------
def _tables(batches: Iterable[pa.RecordBatch], keys: list[str], t: str, interval: int) -> Iterator[pa.RecordBatch]:
    for whole, start in _whole_blocks(batches, [*keys, "_blk"]):
        if not len(start):
            continue
        chains = Chains(whole.column(t).to_numpy(), start, interval)
        last, count = chains.ends()
        t0 = chains.t[start]
        exits, counts = [], []
        for d in range(interval + 1):  # the last emission was d before the block's first row; the last case stands for any earlier one
            first = chains.first(t0 - d, np.full(len(start), d == interval))
            some = first < chains.end
            at = np.where(some, first, start)
            exits.append(np.where(some, chains.t[last[at]], t0 - d))
            counts.append(np.where(some, count[at], 0))
        width = pa.array(np.arange(len(start) + 1) * (interval + 1), pa.int32())
        lists = [pa.ListArray.from_arrays(width, pa.array(np.stack(c, 1).reshape(-1), pa.int64())) for c in (exits, counts)]
        head = whole.select([*keys, "_blk"]).take(pa.array(start))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in head.columns), pa.array(t0, pa.int64()), *lists],
                                         names=[*keys, "_blk", "_t0", "_exit", "_count"])


def _walked(pdf: pd.DataFrame, interval: int, entry: int | None, base: int) -> tuple[list, list, int | None, int]:
    """Entry and emissions so far of each block, and what they are after the last one."""
    entries, bases = [], []
    for t0, exits, counts in zip(pdf["_t0"], pdf["_exit"], pdf["_count"]):
        entries.append(entry)
        bases.append(base)
        d = interval if entry is None else min(t0 - entry, interval)
        entry, base = int(exits[d]), base + int(counts[d])
    return entries, bases, entry, base


def _composed(pdf: pd.DataFrame, interval: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The table of consecutive blocks taken as one."""
    at = count = None
    for t0, exits, counts in zip(pdf["_t0"], pdf["_exit"], pdf["_count"]):
        d = np.arange(interval + 1) if at is None else np.minimum(t0 - at, interval)
        at, count = np.asarray(exits)[d], np.asarray(counts)[d] + (0 if count is None else count)
    return int(pdf["_t0"].iloc[0]), at, count


def block_entries(rows: DataFrame, keys: list[str], t: str, tie: str, interval: int, block: int, fanout: int = FANOUT) -> DataFrame:
    """``(keys, _blk, _entry, _base)`` of the long keys' blocks: the last emission before the block (NULL: none) and the
    number of emissions before it."""
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    table = f"{kinds}, _blk bigint, _t0 bigint, _exit array<bigint>, _count array<bigint>"
    tables = stored(_dealt(rows.select(*keys, t, tie), keys, t, tie, block).mapInArrow(
        lambda it: _tables(it, keys, t, interval), table), "block-tables")
    tables = tables.withColumn("_run", F.floor(F.col("_blk") / F.lit(fanout)).cast("bigint"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        t0, at, count = _composed(pdf, interval)
        return pdf.iloc[:1][[*keys, "_run"]].assign(_t0=t0, _exit=[at], _count=[count])

    def enter_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run")
        entries, bases, _, _ = _walked(pdf, interval, None, 0)
        return pdf[[*keys, "_run"]].assign(_in=pd.array(entries, "Int64"), _before=bases)

    def enter_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        came = pdf["_in"].iloc[0]
        entries, bases, _, _ = _walked(pdf, interval, None if pd.isna(came) else int(came), int(pdf["_before"].iloc[0]))
        return pdf[[*keys, "_blk"]].assign(_entry=pd.array(entries, "Int64"), _base=bases)

    runs = tables.groupBy(*keys, "_run").applyInPandas(
        compose, f"{kinds}, _run bigint, _t0 bigint, _exit array<bigint>, _count array<bigint>")
    entered = runs.groupBy(*keys).applyInPandas(enter_runs, f"{kinds}, _run bigint, _in bigint, _before bigint")
    named = entered.withColumnsRenamed({k: f"_{k}" for k in keys} | {"_run": "_at"})
    cond = tables["_run"] == named["_at"]
    for k in keys:
        cond = cond & tables[k].eqNullSafe(named[f"_{k}"])
    both = tables.join(named, cond).select(*tables.columns, "_in", "_before")
    return both.groupBy(*keys, "_run").applyInPandas(enter_blocks, f"{kinds}, _blk bigint, _entry bigint, _base bigint")


# ---------------------------------------------------------------------------
# the rows
# ---------------------------------------------------------------------------
def _walks(batches: Iterable[pa.RecordBatch], keys: list[str], t: str, interval: int) -> Iterator[tuple]:
    """(rows, first rows of blocks, which rows go out, emissions of the key before each row)."""
    for whole, start in _whole_blocks(batches, [*keys, "_blk"]):
        if not len(start):
            continue
        chains = Chains(whole.column(t).to_numpy(), start, interval)
        entry = whole.column("_entry").take(pa.array(start))
        free = pc.is_null(entry).to_numpy()
        out = chains.reached(chains.first(pc.fill_null(entry, 0).to_numpy(), free))
        before = np.cumsum(out) - out
        base = pc.fill_null(whole.column("_base").take(pa.array(start)), 0).to_numpy()
        yield whole, start, out, before - before[start][chains.of] + base[chains.of]


def with_entries(rows: DataFrame, keys: list[str], t: str, tie: str, interval: int, block: int, long: bool, fanout: int = FANOUT) -> DataFrame:
    """Rows dealt by block, in order, with their block's entry (``long``: of keys that have several blocks)."""
    if not long:
        d = rows.withColumns({"_entry": F.lit(None).cast("bigint"), "_base": F.lit(0).cast("bigint")})
    else:
        # stored, so that the planner sees how few they are and leaves the rows where they are
        entries = stored(block_entries(rows, keys, t, tie, interval, block, fanout), "entries").withColumnsRenamed({k: f"_{k}" for k in keys} | {"_blk": "_at"})
        d = rows.withColumn("_blk", F.floor(F.col(t) / F.lit(block)).cast("bigint"))
        cond = d["_blk"] == entries["_at"]
        for k in keys:
            cond = cond & d[k].eqNullSafe(entries[f"_{k}"])
        d = d.join(entries, cond, "left").select(*rows.columns, "_entry", "_base")
    return _dealt(d, keys, t, tie, block)


def spaced(rows: DataFrame, keys: list[str], t: str, tie: str, interval: int, block: int, extent: DataFrame | None = None,
           fanout: int = FANOUT) -> DataFrame:
    """The rows that go out. ``extent`` (default: the rows) tells which keys are long; any rows that hold all keys and
    times do."""
    ship_package(rows.sparkSession)
    long = long_keys(rows if extent is None else extent, keys, t, block)
    short_rows, long_rows = split_keys(rows, long, keys)
    columns = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _, out, _ in _walks(batches, keys, t, interval):
            yield from whole.select(columns).filter(pa.array(out)).to_batches()

    found = with_entries(short_rows, keys, t, tie, interval, block, False, fanout).mapInArrow(run, rows.schema)
    if long.isEmpty():
        return found
    return found.unionByName(with_entries(long_rows, keys, t, tie, interval, block, True, fanout).mapInArrow(run, rows.schema))
