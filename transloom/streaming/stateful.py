"""Keyed-state stream operators (T3, T4, T6) on ``applyInPandasWithState``; those with timers are in ``streaming.timers``.

State is per user and small: a few strings and numbers. Each micro-batch hands a key's new rows to the function; they are put in order
there, so a key costs the memory of its rows in one trigger, which the source's limit
(``maxFilesPerTrigger`` and the like) bounds. The state carries what the previous
micro-batches left. ``lag`` over a stream is rejected by Spark, hence state.

With ``event_time`` (a timestamp column) the operators take a watermark: later rows are
dropped and counted (``metrics.StreamCounts``), and a key that stays silent for ``idle``
behind the watermark loses its state. Without it state lives for good.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from transloom import constants as K
from transloom.functions.text import GO_SPACE
from transloom.operators.turns import STARTS, STATE, Turn, cleaned, step
from transloom.session import ship_package


def _stateful(step, columns: list[str], event_time: str | None, idle_ms: int):
    """A state function around ``step(key, rows, state) -> (output rows, state or None)``; None ends the key."""
    def fn(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        out, left = step(key, rows, state.get if state.exists else None)
        if left is None:
            state.remove()
        else:
            state.update(left)
        if left is not None and event_time is not None:
            newest = int(rows[event_time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=columns)
    return fn


def _keyed(stream: DataFrame, key: str, step, out: str, state: str, event_time: str | None, watermark: str,
           idle_ms: int) -> DataFrame:
    ship_package(stream.sparkSession)
    if event_time is not None:
        stream = stream.withWatermark(event_time, watermark)
    columns = [c.split()[0] for c in out.split(", ")]
    timeout = GroupStateTimeout.EventTimeTimeout if event_time is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(_stateful(step, columns, event_time, idle_ms), out, state,
                                                      "append", timeout)


IDLE_MS = 24 * 3600 * 1000


# ---------------------------------------------------------------------------
# T4: consecutive duplicate suppression
# ---------------------------------------------------------------------------
STABLE_OUT = "user_id long, n long, trigger string, decision string"
STABLE_STATE = "source string, target string, text string"


def _stable_step(key, rows: pd.DataFrame, last: tuple | None) -> tuple[list, tuple]:
    (user,) = key
    signature = None if last is None or last[0] is None else tuple(last)
    out = []
    rows = rows.sort_values("n")
    for n, trigger, source, target, text in zip(rows["n"], rows["trigger"], rows["source"], rows["target"], rows["text"]):
        text = (text or "").strip(GO_SPACE)
        if not text:
            out.append((int(user), int(n), trigger, "blank"))
            continue
        same = signature == (source, target, text)
        out.append((int(user), int(n), trigger, "skipped" if same and trigger == "auto" else "started"))
        signature = (source, target, text)
    return out, signature or (None, None, None)


def stable_input(stream: DataFrame, event_time: str | None = None, watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """T4: the stream twin of ``operators.feed.stable_input``: an automatic request that equals the
    last started one is skipped, a repeat after another request runs again."""
    return _keyed(stream, "user_id", _stable_step, STABLE_OUT, STABLE_STATE, event_time, watermark, idle_ms)


# ---------------------------------------------------------------------------
# One translation at a time
# ---------------------------------------------------------------------------
def _turn_step(key, rows: pd.DataFrame, last: tuple | None) -> tuple[list, tuple]:
    state, out = Turn() if last is None else Turn(*last), []
    rows = rows.sort_values("n")
    for row in zip(rows["n"].tolist(), rows["kind"], rows["source"], rows["target"], rows["text"]):
        state, started = step(state, *row)
        if started:
            out.append((*key, *started))
    return out, tuple(state)


def turns(stream: DataFrame, event_time: str | None = None, watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """The stream twin of ``operators.turns.turns``: feed, typed and done rows of all users in one stream."""
    rows = cleaned(stream) if event_time is None else cleaned(stream, event_time)
    return _keyed(rows, "user_id", _turn_step, STARTS, STATE, event_time, watermark, idle_ms)


# ---------------------------------------------------------------------------
# Double tap
# ---------------------------------------------------------------------------
TAP_OUT = "user_id long, fire_ms long"
TAP_STATE = "down long, chord boolean, tap long, fired long, at long"


def _tap_step(key, rows: pd.DataFrame, last: tuple | None) -> tuple[list, tuple]:
    (user,) = key
    down, chord, tap, fired, at = last or (None, False, None, None, None)
    events = []
    for k, press, release in zip(rows["key"], rows["press_ms"], rows["release_ms"]):
        events.append((int(press), 0 if k == "ctrl" else 2))
        if k == "ctrl":
            events.append((int(release), 1))
    out = []
    for t, kind in sorted(events):
        if at is not None and t - at > K.TAP_MAX_GAP_MS:  # a long pause resets everything
            down, chord, tap, fired = None, False, None, None
        at = t
        if kind == 0:
            if down is None:
                down, chord = t, False
        elif kind == 2:
            tap, chord = None, chord or down is not None
        elif down is not None:
            clean = not chord and t - down <= K.TAP_MAX_HOLD_MS
            pair = tap is not None and K.TAP_MIN_GAP_MS <= t - tap <= K.TAP_MAX_GAP_MS
            if clean and pair and (fired is None or t - fired >= K.TAP_REFRACTORY_MS):
                out.append((int(user), t))
                fired = t
            tap = t if clean and not pair else None
            down, chord = None, False
    return out, (down, chord, tap, fired, at)


def paired_events(stream: DataFrame, event_time: str | None = None, watermark: str = "1 minute",
                  idle_ms: int = 60_000) -> DataFrame:
    """The stream twin of ``operators.feed.paired_events``. A tap's row arrives when its key is
    released; rows of one user must arrive in order of their triggers."""
    return _keyed(stream, "user_id", _tap_step, TAP_OUT, TAP_STATE, event_time, watermark, idle_ms)
