"""Keyed streams with timers and expiring state (T1, T2) on ``transformWithStateInPandas``.

State is per key and small: the pending deltas of one reply and two times, the last counter of one device. It needs the
RocksDB state store (``session.SESSION_DEFAULTS`` names it), which holds it outside the JVM's heap.

Clocks. With ``clock="event"`` (the default) rows carry their time; a watermark drops rows that come later than
``watermark`` behind the newest one (Spark counts them, ``metrics.StreamCounts`` adds them up), timers fire when the
watermark passes them, and a key that stays silent for one ``watermark`` behind it loses its state. With
``clock="processing"`` timers and the state's time to live follow the machine's clock. With ``clock=None`` there are
neither timers nor expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from transloom import constants as K
from transloom.functions.text import GO_SPACE
from transloom.session import ship_package

WATERMARK = "10 minutes"
MODES = {"event": "EventTime", "processing": "ProcessingTime", None: "None"}


def _millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def _keyed(stream: DataFrame, key: str, ts: str, processor: StatefulProcessor, out: str, clock: str | None, watermark: str,
           initial: DataFrame | None = None) -> DataFrame:
    ship_package(stream.sparkSession)
    if clock == "event":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return stream.groupBy(key).transformWithStateInPandas(
        processor, out, "Append", MODES[clock], None if initial is None else initial.groupBy(key))


class _Expiring(StatefulProcessor):
    """State that goes ``idle_ms`` after the newest row: by a timer in event time, by its time to live otherwise."""

    def __init__(self, clock: str | None, idle_ms: int):
        self.clock, self.idle_ms = clock, idle_ms

    def ttl(self) -> int | None:
        return self.idle_ms if self.clock == "processing" else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.clock == "event":
            self.newest = handle.getValueState("newest", "at long")

    def seen(self, newest: int) -> None:
        """A key's newest row; its expiry moves on."""
        if self.clock != "event":
            return
        before = self.newest.get()
        if before is not None:
            if before[0] >= newest:
                return
            self.handle.deleteTimer(before[0] + self.idle_ms)
        self.newest.update((newest,))
        self.handle.registerTimer(newest + self.idle_ms)

    def idle(self, at: int) -> bool:
        """Whether a timer that fires at ``at`` ends the key."""
        if self.clock != "event":
            return False
        newest = self.newest.get()
        return newest is not None and at >= newest[0] + self.idle_ms

    def forget(self) -> None:
        if self.clock == "event":
            newest = self.newest.get()
            if newest is not None:
                self.handle.deleteTimer(newest[0] + self.idle_ms)
                self.newest.clear()

    def close(self) -> None:
        pass


# ---------------------------------------------------------------------------
# Delta coalescing
# ---------------------------------------------------------------------------
COALESCE_OUT = "request_id string, emit_ms long, text string"


class _Deltas(_Expiring):
    def __init__(self, interval_ms: int, flush: bool, clock: str | None, idle_ms: int):
        super().__init__(clock, idle_ms)
        self.interval_ms, self.flush = interval_ms, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getListState("pending", "delta string", self.ttl())
        self.sent = handle.getValueState("sent", "last long", self.ttl())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (request_id,) = key
        got = pd.concat(list(rows)).sort_values(["t_ms", "seq"], kind="stable")
        sent = self.sent.get()
        last, held, out, ended = None if sent is None else sent[0], [d for d, in self.pending.get()], [], False
        for t, kind, delta in zip(got["t_ms"].tolist(), got["kind"], got["delta"]):
            if self.flush and held and t > last + self.interval_ms:  # what the timer owes comes before this row
                last += self.interval_ms
                out.append((request_id, last, "".join(held)))
                held = []
            if kind == "delta":
                held.append(delta or "")
                if last is None or t - last >= self.interval_ms:
                    out.append((request_id, t, "".join(held)))
                    last, held = t, []
                ended = False
            else:  # success sends what is pending, an error drops it
                if kind == "end" and held:
                    out.append((request_id, t, "".join(held)))
                last, held, ended = None, [], True
        self._keep(last, held)
        if ended:
            self.forget()
        else:
            self.seen(int(got["t_ms"].max()))
            if held and self.flush and self.clock:
                due = last + self.interval_ms if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs() + self.interval_ms
                self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame([r for r in out if r[2]], columns=["request_id", "emit_ms", "text"])

    def _keep(self, last: int | None, held: list[str]) -> None:
        if last is None:
            self.sent.clear()
            self.pending.clear()
            return
        self.sent.update((last,))
        if held:
            self.pending.put([(d,) for d in held])
        else:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, sent = expiredTimerInfo.getExpiryTimeInMs(), self.sent.get()
        held = [d for d, in self.pending.get()] if sent is not None else []
        if held and (self.clock == "processing" or at >= sent[0] + self.interval_ms):
            due = sent[0] + self.interval_ms
            self._keep(due, [])
            if any(held):
                yield pd.DataFrame([(key[0], due, "".join(held))], columns=["request_id", "emit_ms", "text"])
        if self.idle(at):
            self._keep(None, [])
            self.forget()


def coalesce_deltas(stream: DataFrame, interval_ms: int = K.DELTA_INTERVAL_MS, flush: bool = True, clock: str | None = "event",
                    watermark: str = WATERMARK, idle_ms: int | None = None) -> DataFrame:
    """``(request_id, seq, t_ms, kind, delta)``, kind delta, end or error, to emissions ``(request_id, emit_ms, text)``.

    The first delta goes out at once, later ones when ``interval_ms`` have passed since the last emission. With ``flush``
    (the default) what is pending then leaves without another row, stamped with the moment it was due: a timer sends it,
    or the next row of the reply, if that comes first, before it is looked at itself. So the emissions depend on
    the rows' times only, not on how they fall into micro-batches. Without ``flush`` pending text waits for the next
    delta (``operators.feed.delta_batches`` is the batch twin). An end marker sends what is pending, an error marker drops it.

    A micro-batch's rows of one reply are sorted in memory; the source's trigger limit bounds them.
    """
    idle = _millis(watermark) if idle_ms is None else idle_ms
    stream = stream.select("request_id", "seq", "t_ms", "kind", "delta", F.timestamp_millis("t_ms").alias("ts"))
    return _keyed(stream, "request_id", "ts", _Deltas(interval_ms, flush, clock, idle), COALESCE_OUT, clock, watermark)


# ---------------------------------------------------------------------------
# Change feed
# ---------------------------------------------------------------------------
FEED_OUT = "device long, poll long, seq long, text string"


class _Polls(_Expiring):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq long", self.ttl())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["seq"].iloc[0]),))
        if self.clock == "event" and "ts" in initialState:
            self.seen(int(initialState["ts"].iloc[0].timestamp() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("poll")
        known = self.last.get()
        seen, out = None if known is None else known[0], []
        for poll, seq, after, ok, origin, text in zip(got["poll"].tolist(), got["seq"].tolist(), got["seq_after"].tolist(),
                                                      got["read_ok"], got["origin"], got["text"]):
            if seen is None:  # the first observation is the baseline
                seen = seq
                continue
            if seq == 0 or seq == seen or not ok or after != seq:
                continue
            seen = seq
            if origin != "self" and (text or "").strip(GO_SPACE):
                out.append((key[0], poll, seq, text))
        self.last.update((int(seen),))
        if self.clock == "event":
            self.seen(int(got["ts"].max().timestamp() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["device", "poll", "seq", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.idle(expiredTimerInfo.getExpiryTimeInMs()):
            self.last.clear()
            self.forget()
        yield from ()


def change_feed(stream: DataFrame, clock: str | None = "event", watermark: str = WATERMARK, idle_ms: int | None = None,
                baselines: DataFrame | None = None) -> DataFrame:
    """The stream twin of ``operators.feed.change_feed``: ``(device, poll, seq, seq_after, read_ok, origin, text, ts)`` to the
    changes that fire. ``baselines`` ``(device, seq, ts)`` (a batch table, one row per device) is where devices go on from, so a new
    query does not take their next poll for a first one."""
    idle = _millis(watermark) if idle_ms is None else idle_ms
    return _keyed(stream, "device", "ts", _Polls(clock, idle), FEED_OUT, clock, watermark, baselines)


def last_counters(polls: DataFrame) -> DataFrame:
    """Baselines of a feed's past: per device the last counter that was read whole (else the first one), and when."""
    valid = (F.col("seq") != 0) & F.col("read_ok") & (F.col("seq_after") == F.col("seq"))
    return polls.groupBy("device").agg(
        F.coalesce(F.max_by("seq", F.when(valid, F.col("poll"))), F.min_by("seq", "poll")).alias("seq"), F.max("ts").alias("ts"))
