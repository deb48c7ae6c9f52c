"""Input feeds in batch form (W2, W3, W6, T3, T6); streaming twins live in ``transloom.streaming``.

Consecutive comparisons are cut into blocks (parallel on a hot key). The two folds
whose state depends on the previous *emission* (W6, T6) are cut into blocks as well; see
``operators.spacing``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import go_trim
from transloom.operators.ordering import DEFAULT_BLOCK, keyed_lag
from transloom.operators.spacing import FANOUT, _walks, long_keys, spaced, split_keys, with_entries
from transloom.session import ship_package

DELTA_BLOCK_MS = 1 << 16


# ---------------------------------------------------------------------------
# Stable-input dedup
# ---------------------------------------------------------------------------
def stable_input(typed: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Blank input is skipped; button and feed requests always start; an automatic request
    is skipped when its (source, target, text) equals the last started one. A skipped row
    always carries the last started signature, so the previous non-blank row decides."""
    t = typed.withColumn("_text", go_trim("text"))
    blank = t.where(F.col("_text") == "")
    filled = keyed_lag(t.where(F.col("_text") != ""), ["user_id"], "n", ["source", "target", "_text"], block)
    same = ((F.col("prev_source") == F.col("source")) & (F.col("prev_target") == F.col("target"))
            & (F.col("prev__text") == F.col("_text")))
    started = (F.col("trigger") != "auto") | F.col("prev__text").isNull() | ~same
    decided = filled.select("user_id", "n", "trigger",
                            F.when(started, F.lit("started")).otherwise(F.lit("skipped")).alias("decision"))
    return decided.unionByName(blank.select("user_id", "n", "trigger", F.lit("blank").alias("decision")))


# ---------------------------------------------------------------------------
# Clipboard-style change detection
# ---------------------------------------------------------------------------
def change_feed(polls: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per device, in poll order: the first poll is the baseline; a zero counter, a failed
    or torn read, and an unchanged counter are ignored; a change advances the baseline and
    fires unless the device wrote it itself or the text is blank.

    One aggregate per (device, block) gives both the device's first poll and the counter that
    each block hands on; the polls are shuffled once.
    """
    valid = (F.col("seq") != 0) & F.col("read_ok") & (F.col("seq_after") == F.col("seq"))
    d = polls.withColumn("_blk", F.floor(F.col("poll") / F.lit(block)).cast("bigint"))
    ends = d.groupBy("device", "_blk").agg(
        F.min("poll").alias("_head"), F.min_by("seq", "poll").alias("_seq0"),
        F.max_by("seq", F.when(valid, F.col("poll"))).alias("_seq1"))
    wb = Window.partitionBy("device").orderBy("_blk")
    first_block = F.row_number().over(wb) == 1
    # what a block leaves behind: its last valid counter, in the first block at least the baseline
    ends = ends.withColumns({"_left": F.coalesce("_seq1", F.when(first_block, F.col("_seq0"))),
                             "_base": F.when(first_block, F.col("_head"))})
    carry = ends.select("device", "_blk", "_base", F.last("_left", ignorenulls=True).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    d = d.join(carry, ["device", "_blk"], "left").withColumn("_first", F.coalesce(F.col("poll") == F.col("_base"), F.lit(False)))
    kept = d.where(F.col("_first") | valid)
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("device", "_blk").orderBy("poll")), F.col("_carry"))
    kept = kept.withColumn("_prev", before)
    fires = (~F.col("_first") & (F.col("seq") != F.col("_prev")) & (F.col("origin") != "self") & (go_trim("text") != ""))
    return kept.where(fires).select("device", "poll", "seq", "text")


# ---------------------------------------------------------------------------
# Latest wins while busy
# ---------------------------------------------------------------------------
def latest_wins(polls: DataFrame, batch_polls: int = 100, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Of the feed texts that fire within one trigger batch, only the newest is translated;
    the rest are superseded. Batches are ``batch_polls`` poll ids wide."""
    fired = change_feed(polls, block)
    g = fired.groupBy("device", F.floor(F.col("poll") / batch_polls).cast("bigint").alias("batch_no")).agg(
        F.max_by(F.struct("poll", "text"), F.col("poll")).alias("last"), F.count(F.lit(1)).alias("n_fired"))
    return g.select("device", "batch_no", F.col("last.poll").alias("poll"), go_trim("last.text").alias("text"),
                    (F.col("n_fired") - 1).cast("bigint").alias("n_superseded"))


# ---------------------------------------------------------------------------
# Delta emission batches
# ---------------------------------------------------------------------------
_BATCHES = "request_id string, batch_no bigint, first_seq bigint, n_deltas bigint, text string"


def _pieces(batches: Iterable[pa.RecordBatch], interval_ms: int) -> Iterator[pa.RecordBatch]:
    """What each block holds of each batch. Deltas lie end to end in Arrow's buffer, so the text of a piece is the same
    bytes under wider offsets."""
    for whole, start, out, slot in _walks(batches, ["request_id"], "t_ms", interval_ms):
        first = np.union1d(start, np.flatnonzero(out) + 1)
        first = first[first < whole.num_rows]
        at = pa.array(first)
        delta = pc.fill_null(whole.column("delta").combine_chunks(), "").cast(pa.large_string())
        offsets = np.frombuffer(delta.buffers()[1], np.int64)[delta.offset:delta.offset + len(delta) + 1]
        ends = np.r_[first, whole.num_rows]
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets[ends].tobytes()), delta.buffers()[2])
        yield pa.RecordBatch.from_arrays(
            [whole.column("request_id").combine_chunks().take(at), pa.array(slot[first], pa.int64()),
             whole.column("seq").combine_chunks().take(at), pa.array(np.diff(ends), pa.int64()), text.cast(pa.string())],
            names=["request_id", "batch_no", "first_seq", "n_deltas", "text"])


def delta_batches(deltas: DataFrame, interval_ms: int = K.DELTA_INTERVAL_MS, block: int = DELTA_BLOCK_MS,
                  fanout: int = FANOUT) -> DataFrame:
    """The first delta goes out at once; later ones when ``interval_ms`` have passed since the last emission; what is
    pending at the end is flushed. One row per emission. Deltas arrive in order of time, those of one time in order of
    ``seq``.

    Which deltas end a batch is found by ``operators.spacing``: a reply of any length takes as many tasks as it has
    blocks of time. A batch that lies across blocks is put together from its pieces; replies of one block need no
    second shuffle.
    """
    ship_package(deltas.sparkSession)
    rows = deltas.select("request_id", "seq", "t_ms", "delta")
    keys = ["request_id"]
    long = long_keys(rows, keys, "t_ms", block)
    short_rows, long_rows = split_keys(rows, long, keys)
    batches = with_entries(short_rows, keys, "t_ms", "seq", interval_ms, block, False).mapInArrow(
        lambda it: _pieces(it, interval_ms), _BATCHES)
    if long.isEmpty():
        return batches
    pieces = with_entries(long_rows, keys, "t_ms", "seq", interval_ms, block, True, fanout) \
        .mapInArrow(lambda it: _pieces(it, interval_ms), _BATCHES)
    in_order = F.array_sort(F.collect_list(F.struct("first_seq", "n_deltas", "text")))
    whole = pieces.groupBy("request_id", "batch_no").agg(in_order.alias("p")).select(
        "request_id", "batch_no", F.col("p")[0]["first_seq"].alias("first_seq"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["n_deltas"]).alias("n_deltas"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return batches.unionByName(whole)


# ---------------------------------------------------------------------------
# Paired events (double tap) with a refractory period
# ---------------------------------------------------------------------------
def tap_items(taps: DataFrame, max_hold: int) -> DataFrame:
    """``(user_id, ord, t, press, short)``: a release of the modifier (``press`` is when it went down, ``short`` whether it was
    held no longer than ``max_hold``) or the press of another key (``press`` NULL)."""
    mod = F.col("key") == "ctrl"
    t = F.when(mod, F.col("release_ms")).otherwise(F.col("press_ms"))
    return taps.select("user_id", (t * 4 + F.when(mod, F.lit(1)).otherwise(F.lit(2))).alias("ord"), t.alias("t"),
                       F.when(mod, F.col("press_ms")).alias("press"), (mod & (t - F.col("press_ms") <= max_hold)).alias("short"))


def paired_events(taps: DataFrame, min_gap: int = K.TAP_MIN_GAP_MS, max_gap: int = K.TAP_MAX_GAP_MS,
                  max_hold: int = K.TAP_MAX_HOLD_MS, refractory: int = K.TAP_REFRACTORY_MS,
                  block: int = DEFAULT_BLOCK, fanout: int = FANOUT) -> DataFrame:
    """Fire on two clean modifier taps whose releases are ``min_gap..max_gap`` ms apart.
    A clean tap is held at most ``max_hold`` ms with no other key pressed meanwhile; another
    key clears a pending tap; fires are at least ``refractory`` ms apart.

    Input contract: taps of one key of one user do not overlap (a key cannot go down again
    while it is held).

    The state machine is three questions, none of which walks a run of taps:

    * Is a tap clean? The last press of another key before its release must lie before its own press.
    * Does it close a pair? A pending tap is the item just before, if that was clean and closed no pair itself. So
      among taps that follow each other closely enough, every second one closes a pair: the parity of the distance to
      the last tap that couldn't.
    * Does the pair fire? Pairs keep the refractory period like emissions (``operators.spacing``).

    Each block of a user hands on its last press, its last item and the length of its closing stretch, one row a
    block, so a run of any length takes as many tasks as it has blocks.
    """
    items = tap_items(taps, max_hold).withColumn("_blk", F.floor(F.col("t") / F.lit(block)).cast("bigint"))
    keys = ["user_id", "_blk"]
    rows, over = Window.partitionBy(*keys).orderBy("ord"), Window.partitionBy("user_id").orderBy("_blk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("press").isNull(), F.col("t"))
    presses = items.groupBy(*keys).agg(F.max(other).alias("_o")).select(*keys, F.max("_o").over(earlier).alias("_o"))
    last_other = F.coalesce(F.max(other).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.col("_o"))
    clean = items.join(presses, keys, "left").select(
        "user_id", "_blk", "ord", "t", (F.col("short") & F.coalesce(last_other < F.col("press"), F.lit(True))).alias("clean"))

    item = F.struct("t", "clean")
    ends = clean.groupBy(*keys).agg(F.max_by(item, F.col("ord")).alias("_end")).select(*keys, F.lag("_end").over(over).alias("_end"))
    before = F.coalesce(F.lag(item).over(rows), F.col("_end"))
    close = F.col("clean") & before["clean"] & (F.col("t") - before["t"]).between(min_gap, max_gap)
    close = clean.join(ends, keys, "left").select("user_id", "_blk", "ord", "t", F.coalesce(close, F.lit(False)).alias("close"),
                                                  F.row_number().over(rows).alias("_n"))

    apart = F.when(~F.col("close"), F.col("_n"))  # an item that closes no pair, whatever came before
    stretch = close.groupBy(*keys).agg(F.max("_n").alias("_rows"), F.max(apart).alias("_apart"))
    stretch = stretch.withColumn("_to", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    stretch = stretch.select(*keys, "_to", F.max(F.col("_to") + F.col("_apart")).over(earlier).alias("_since"))
    at = F.col("_to") + F.col("_n")
    since = F.coalesce(F.col("_to") + F.max(apart).over(rows.rowsBetween(Window.unboundedPreceding, 0)), F.col("_since"))
    pairs = close.join(stretch, keys, "left").select("user_id", "t", "ord", "close", ((at - since) % 2 == 1).alias("odd")) \
        .where(F.col("close") & F.col("odd")).select("user_id", "t", "ord")
    fires = spaced(pairs, ["user_id"], "t", "ord", refractory, block, extent=items.select("user_id", "t"), fanout=fanout)
    return fires.select("user_id", F.col("t").alias("fire_ms"))
