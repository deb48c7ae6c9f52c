"""One translation at a time: what runs next while one is running.

Two inputs compete: texts of the change feed and text typed by the user. Each has one pending slot per user. While a
translation runs, a newer feed text replaces the pending one, and so does newer typed text in its own slot. When the
translation is done, the feed's slot runs first; typed text runs only if no feed text waits and the text box still
holds it in the same languages. Typed text that equals the last started translation is not run again; feed text always
runs, and takes over the text box.

What runs depends on what ran before. A user of up to ``block_rows`` rows is streamed in order with a constant state: one
shuffle by user, a sort, one pass. A user of more rows is cut into blocks of ``n``, which different tasks stream:

* Who starts at a row is settled by the rows before it, not by the history of starts: text that was pending at a ``done`` is the last
  feed text, or the last typed text, before it. So each block is told these (``_lasts``), and needs to follow few
  cases only: an entry that runs starts the feed's or the typed text at the block's first ``done``, or nothing; one that
  does not, or no longer, starts the first feed text, the first typed text, or (if that is what ran last) the first other one.
* Each case is followed to the block's end (``_followed``); cases that come to the same state go on as one. A block is then a
  row: its cases and the states they end in. A user's blocks are walked by that, one row a block (``_walked``), which gives
  each block's entry state, and the blocks are streamed from there.

``streaming.stateful.turns`` runs the same step on a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.functions.text import go_trim
from transloom.session import ship_package, stored

STARTS = "user_id long, n long, started long, origin string, source string, target string, text string"
BLOCK_ROWS = 1 << 18
STATE = ("busy boolean, last_source string, last_target string, last_text string, feed_n long, feed_text string, typed_n long, "
         "typed_source string, typed_target string, typed_text string, box string, source string, target string")


class Turn(NamedTuple):
    """The state of one user; the columns of ``STATE``."""
    busy: bool = False
    last_source: str | None = None
    last_target: str | None = None
    last_text: str | None = None
    feed_n: int | None = None
    feed_text: str | None = None
    typed_n: int | None = None
    typed_source: str | None = None
    typed_target: str | None = None
    typed_text: str | None = None
    box: str = ""
    source: str = ""
    target: str = ""

    def start(self, source: str, target: str, text: str, **more) -> Turn:
        return self._replace(busy=True, last_source=source, last_target=target, last_text=text, **more)


NO_FEED = {"feed_n": None, "feed_text": None}
NO_TYPED = {"typed_n": None, "typed_source": None, "typed_target": None, "typed_text": None}


def step(state: Turn, n: int, kind: str, source: str, target: str, text: str) -> tuple[Turn, tuple | None]:
    """One row (``text`` is trimmed) -> the next state and the translation that starts: (n, started, origin, source,
    target, text), if one does. ``n`` is the row that asked, ``started`` the row at which it starts."""
    if kind == "done":
        if not state.busy:
            return state, None
        if state.feed_text is not None:
            asked, text = state.feed_n, state.feed_text
            return (state.start(state.source, state.target, text, box=text, **NO_FEED),
                    (asked, n, "feed", state.source, state.target, text))
        asked, wish = state.typed_n, (state.typed_source, state.typed_target, state.typed_text)
        state = state._replace(busy=False, **NO_TYPED)
        if (wish[2] is None or wish != (state.source, state.target, state.box)
                or wish == (state.last_source, state.last_target, state.last_text)):
            return state, None
        return state.start(*wish), (asked, n, "typed", *wish)
    if kind == "feed":
        if not text:
            return state, None
        state = state._replace(source=source, target=target)
        if state.busy:
            return state._replace(feed_n=n, feed_text=text), None
        return state.start(source, target, text, box=text, **NO_FEED), (n, n, "feed", source, target, text)
    state = state._replace(source=source, target=target, box=text)
    if not text or (source, target, text) == (state.last_source, state.last_target, state.last_text):
        return state, None
    if state.busy:
        return state._replace(typed_n=n, typed_source=source, typed_target=target, typed_text=text), None
    return state.start(source, target, text, **NO_TYPED), (n, n, "typed", source, target, text)


def settled(state: Turn) -> Turn:
    """The state without what can't matter any more, so that states that behave alike are equal: languages and box are set by
    the row that makes them count, and pending typed text counts only while the box holds it and no feed text waits."""
    last = state[1:4]
    if not state.busy:
        return Turn(False, *last)
    if state.feed_text is not None:
        return Turn(True, *last, state.feed_n, state.feed_text, source=state.source, target=state.target)
    wish = (state.typed_source, state.typed_target, state.typed_text)
    if state.typed_text is None or wish != (state.source, state.target, state.box) or wish == last:
        return Turn(True, *last)
    return Turn(True, *last, None, None, state.typed_n, *wish, state.box, state.source, state.target)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(pdf: pd.DataFrame, *first: str) -> Iterator[tuple]:
    return zip(*(pdf[c].tolist() for c in (*first, "n", "kind", "source", "target", "text")))


def _streamed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by user, block and n. A row of kind ``entry`` at a block's head holds the state to go on from."""
    at, state = None, None
    for pdf in batches:
        out = []
        for who, block, *row in _rows(pdf, "user_id", "_blk"):
            if (who, block) != at:
                at, state = (who, block), Turn()
            if row[1] == "entry":
                state = Turn(*json.loads(row[4]))
                continue
            state, started = step(state, *row)
            if started:
                out.append((who, *started))
        yield pd.DataFrame(out, columns=_columns(STARTS))


def cleaned(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "user_id", "n", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "target")],
                       go_trim(F.coalesce("text", F.lit(""))).alias("text"))


# ---------------------------------------------------------------------------
# users of many rows
# ---------------------------------------------------------------------------
_BLOCK = "user_id long, _blk long, summary string"


class _Idle:
    """What starts first if nothing runs from here on: feed text, or typed text that differs from what ran last."""

    def __init__(self):
        self.typed: list | None = None
        self.names: dict[str, bool] = {}

    def meets(self, kind: str, triple: list) -> str | None:
        """The name of the case that starts at this row, if one does."""
        if "feed" in self.names or kind == "done" or not triple[2]:
            return None
        name = "feed"
        if kind == "typed":
            if self.typed is None:
                self.typed, name = triple, "typed"
            elif "other" not in self.names and triple != self.typed:
                name = "other"
            else:
                return None
        self.names[name] = True
        return name

    def starts(self, last: list) -> str | None:
        order = ("typed", "other", "feed") if self.typed != last else ("other", "feed")
        return next((name for name in order if name in self.names), None)


class _Lasts:
    """The last feed text, typed row and languages."""

    def __init__(self, feed=None, typed=None, languages=None):
        self.feed, self.typed, self.languages = feed, typed, languages

    def see(self, n: int, kind: str, source: str, target: str, text: str) -> None:
        if kind == "typed":
            self.typed = [n, source, target, text]
        elif kind == "feed" and text:
            self.feed = [n, text]
        else:
            return
        self.languages = [source, target]

    def after(self, before: _Lasts) -> _Lasts:
        return _Lasts(self.feed or before.feed, self.typed or before.typed, self.languages or before.languages)

    def pending(self, state: Turn) -> Turn:
        """A running state after rows that end nothing, of which these are the last ones."""
        if self.feed:
            state = state._replace(feed_n=self.feed[0], feed_text=self.feed[1])
        if self.typed:
            n, *wish = self.typed
            state = state._replace(box=wish[2])
            if wish[2] and tuple(wish) != state[1:4]:
                state = state._replace(typed_n=n, typed_source=wish[0], typed_target=wish[1], typed_text=wish[2])
        return state._replace(source=self.languages[0], target=self.languages[1]) if self.languages else state


class _Followed:
    """One block: its cases, each from the row where it starts to the block's end."""

    def __init__(self, before: _Lasts):
        self.before, self.seen, self.done = before, _Lasts(), None
        self.idle, self.later = _Idle(), _Idle()  # from the block's start, from its first ``done``
        self.live: dict[Turn, list[str]] = {}

    def see(self, n: int, kind: str, source: str, target: str, text: str) -> None:
        moved: dict[Turn, list[str]] = {}
        for state, names in self.live.items():
            moved.setdefault(settled(step(state, n, kind, source, target, text)[0]), []).extend(names)
        self.live = moved
        for prefix, probe in (("idle ", self.idle), ("later ", self.later)):
            if prefix == "idle " or self.done is not None:
                name = probe.meets(kind, [source, target, text])
                if name:
                    self._follow(prefix + name, Turn().start(source, target, text))
        if self.done is None and kind == "done":
            self.done = n
            known = self.seen.after(self.before)
            if known.feed:
                self._follow("done feed", Turn().start(*known.languages, known.feed[1]))
            if known.typed and known.typed[3]:
                self._follow("done typed", Turn().start(*known.typed[1:]))
        elif self.done is None:
            self.seen.see(n, kind, source, target, text)

    def _follow(self, name: str, state: Turn) -> None:
        self.live.setdefault(settled(state), []).append(name)

    def summary(self) -> str:
        ends = list(self.live)
        return json.dumps({
            "done": self.done, "seen": [self.seen.feed, self.seen.typed, self.seen.languages], "ends": ends,
            "cases": {name: i for i, state in enumerate(ends) for name in self.live[state]},
            "typed": [self.idle.typed, self.later.typed]}, ensure_ascii=False)


def _followed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order of n, each with an ``entry`` row of what was last before it, to one row a block."""
    at, block = None, None
    for pdf in batches:
        out = []
        for who, blk, *row in _rows(pdf, "user_id", "_blk"):
            if (who, blk) != at:
                if at is not None:
                    out.append((*at, block.summary()))
                at, block = (who, blk), _Followed(_Lasts())
            if row[1] == "entry":
                known = json.loads(row[4])
                block = _Followed(_Lasts(known.get("feed") and [known["feed"]["n"], known["feed"]["text"]],
                                         known.get("typed") and [known["typed"][c] for c in ("n", "source", "target", "text")],
                                         known.get("lang") and [known["lang"]["source"], known["lang"]["target"]]))
                continue
            block.see(*row)
        yield pd.DataFrame(out, columns=_columns(_BLOCK))
    if at is not None:
        yield pd.DataFrame([(*at, block.summary())], columns=_columns(_BLOCK))


def _through(state: Turn, block: dict) -> Turn:
    """The state after a block."""
    def go_on(state: Turn, prefix: str, typed: list | None) -> Turn:
        probe = _Idle()
        probe.typed = typed
        probe.names = {name[len(prefix):]: True for name in block["cases"] if name.startswith(prefix)}
        name = probe.starts(list(state[1:4]))
        return state if name is None else ends(prefix + name)

    def ends(name: str) -> Turn:
        return Turn(*block["ends"][block["cases"][name]])

    if not state.busy:
        return go_on(state, "idle ", block["typed"][0])
    state = _Lasts(*block["seen"]).pending(state)
    if block["done"] is None:
        return settled(state)
    state, started = step(state, block["done"], "done", "", "", "")
    return ends(f"done {started[2]}") if started else go_on(settled(state), "later ", block["typed"][1])


def _walked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order to each one's entry state."""
    user, state = None, Turn()
    for pdf in batches:
        out = []
        for who, blk, summary in zip(pdf["user_id"].tolist(), pdf["_blk"].tolist(), pdf["summary"]):
            if who != user:
                user, state = who, Turn()
            out.append((who, blk, json.dumps(state, ensure_ascii=False)))
            state = _through(state, json.loads(summary))
        yield pd.DataFrame(out, columns=_columns(_BLOCK))


def _lasts(rows: DataFrame) -> DataFrame:
    """``(user_id, _blk, summary)``: the last feed text, typed row and languages before each block."""
    feed = (F.col("kind") == "feed") & (F.col("text") != "")
    typed = F.col("kind") == "typed"
    found = rows.groupBy("user_id", "_blk").agg(
        F.max_by(F.struct("n", "text"), F.when(feed, F.col("n"))).alias("feed"),
        F.max_by(F.struct("n", "source", "target", "text"), F.when(typed, F.col("n"))).alias("typed"),
        F.max_by(F.struct("source", "target"), F.when(feed | typed, F.col("n"))).alias("lang"))
    earlier = Window.partitionBy("user_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("user_id", "_blk", F.to_json(F.struct(*[
        F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("feed", "typed", "lang")])).alias("summary"))


def _dealt(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows by block and in order, each block's head first."""
    first = heads.select("user_id", "_blk", F.lit(0).cast("bigint").alias("n"), F.lit("entry").alias("kind"),
                         F.lit("").alias("source"), F.lit("").alias("target"), F.col("summary").alias("text"))
    both = rows.select(*first.columns).withColumn("_head", F.lit(False)).unionByName(first.withColumn("_head", F.lit(True)))
    return both.repartition("user_id", "_blk").sortWithinPartitions("user_id", "_blk", F.desc("_head"), "n").drop("_head")


def _split(rows: DataFrame) -> DataFrame:
    """The starts of users of many rows; ``_blk`` is set."""
    followed = stored(_dealt(rows, _lasts(rows)).mapInPandas(_followed, _BLOCK), "turn-blocks")
    entries = followed.repartition("user_id").sortWithinPartitions("user_id", "_blk").mapInPandas(_walked, _BLOCK)
    return _dealt(rows, entries).mapInPandas(_streamed, STARTS)


def turns(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(user_id, n, kind, source, target, text)``, kind feed, typed or done, to the translations that start:
    ``(user_id, n, started, origin, source, target, text)``. A ``done`` without a running translation is ignored; blank
    feed text is ignored; blank typed text empties the text box. ``n`` orders a user's rows, no two have the same."""
    ship_package(rows.sparkSession)
    rows = cleaned(rows.where(F.col("user_id").isNotNull()))
    spans = rows.groupBy("user_id").agg(F.count("*").alias("_rows"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    many = stored(spans.where(F.col("_rows") > block_rows).withColumnRenamed("user_id", "_long_user"), "long-users")
    is_long = F.col("user_id") == F.col("_long_user")
    ordered = rows.join(many, is_long, "left_anti").withColumn("_blk", F.lit(0).cast("bigint")) \
        .repartition("user_id").sortWithinPartitions("user_id", "n")
    found = ordered.mapInPandas(_streamed, STARTS)
    if many.isEmpty():
        return found
    pieces = F.ceil(F.col("_rows") / block_rows)
    n, low, high = (F.col(c).cast("double") for c in ("n", "_lo", "_hi"))
    place = F.floor((n - low) / (high - low + 1) * pieces).cast("bigint")
    return found.unionByName(_split(rows.join(many, is_long).withColumn("_blk", place).select(*rows.columns, "_blk")))
