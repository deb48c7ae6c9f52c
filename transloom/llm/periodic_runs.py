"""Periodic runs of words, found by catching squares online in dyadic blocks.

A square is a stretch of 2p words whose halves are equal. Every half of p >= 2b words holds a whole aligned block of
b = 2^k words, so that block comes back p words later. ``SquareCatcher`` takes words as they are appended. Whenever a
window of b words is complete, it is compared with the catchers that are alive for it: the aligned blocks that
started 2b to 4b - 1 words before (for single words 1 to 3). There are two such catchers for each window and level, so
a text of n words costs O(n log n), whatever repeats in it. A match opens a suffix comparison of the text with itself
shifted by p; each later block that matches at the same shift advances it, the first one that doesn't ends it, and
binary descent over smaller blocks finds the last equal word. Squares of one period that overlap are one comparison, so
they merge into one run as they come. Of equal stretches the smallest period stays.

Blocks are compared by 64-bit hashes; a hash that is wrong can only make a run longer, so each run that is reported is
compared word by word, and on a mismatch the work is done again with other hashes. Results are exact.

The texts of one slice of rows are appended one after the other, a word of its own between them, in slabs of
``SLAB`` words; state goes on from slab to slab. Memory is that of the slice (or of one text, if longer): 8 bytes a word
and level.

Edge cases: a null, empty or blank text has no word, no run, and the hash of the empty string; a null id counts as the
empty string where the id decides; repeated rows and ids each give their own row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import slices
from transloom.session import ship_package

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLAB = 1 << 17
SCHEMA = ("doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


class _Grown:
    """An array that grows by appending."""

    def __init__(self):
        self.held, self.n = np.empty(1024, np.uint64), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.empty(self.n + 2 * len(values), np.uint64)])
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[:self.n]


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SquareCatcher:
    """Words (numbers) are appended; ``finish`` gives all runs as arrays (start, end, period).

    ``longest``: no square of a period above this is looked for."""

    def __init__(self, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, seed: int = 1):
        self.min_length, self.min_exponent, self.seed = min_length, max(min_exponent, 2), seed
        self.levels = max(1, int(longest).bit_length() - 1)
        self.hashes = [_Grown() for _ in range(self.levels)]
        none = np.zeros(0, np.int64)
        self.open = [(none, none, none)] * self.levels  # of each level: period, last block, left end
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def append(self, words: np.ndarray) -> None:
        for k, grown in enumerate(self.hashes):
            before = grown.n
            if k == 0:
                grown.extend(_mixed(words.astype(np.uint64), np.uint64(0), self.seed))
            else:
                half, lower = 1 << (k - 1), self.hashes[k - 1].all
                last = max(len(lower) - half, before)
                grown.extend(_mixed(lower[before:last], lower[before + half:last + half], self.seed + k))
            self._catch(k, before)

    def _catch(self, k: int, before: int) -> None:
        """Compare the windows that are new at this level with the catchers alive for them."""
        h = self.hashes[k].all
        if len(h) == before:
            return
        starts = np.arange(before, len(h))
        periods, blocks = [], []
        for back in ((1, 2, 3) if k == 0 else (2, 3)):
            block = (starts >> k) - back
            hit = np.flatnonzero((h[np.maximum(block, 0) << k] == h[before:]) & (block >= 0))
            blocks.append(block[hit])
            periods.append(starts[hit] - (block[hit] << k))
        self._advance(k, np.concatenate(periods), np.concatenate(blocks))

    def _advance(self, k: int, period: np.ndarray, block: np.ndarray) -> None:
        """Matches go on with the comparison that is open at their shift or open one; what can't go on is closed."""
        was_p, was_b, was_l = self.open[k]
        period, block = np.concatenate([was_p, period]), np.concatenate([was_b, block])
        left = np.concatenate([was_l, np.full(len(period) - len(was_l), -1)])
        if not len(period):
            return
        order = np.lexsort((block, period))
        period, block, left = period[order], block[order], left[order]
        first = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)])
        last = np.r_[first[1:], len(period)] - 1
        period, block, left, end = period[first], block[first], left[first], block[last]
        new = left < 0
        left[new] = self._leftwards(k, block[new] << k, period[new])
        alive = ((end + 1) << k) + period >= self.hashes[k].n  # the next window is not complete
        self.open[k] = (period[alive], end[alive], left[alive])
        self._close(k, period[~alive], end[~alive], left[~alive])

    def _leftwards(self, k: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The first of the equal words before ``at``: fewer than a block, since the block before doesn't match."""
        at = at.copy()
        for i in range(k - 1, -1, -1):
            h, step = self.hashes[i].all, 1 << i
            to = np.maximum(at - step, 0)
            at -= step * ((at >= step) & (h[to] == h[to + period]))
        return at

    def _close(self, k: int, period: np.ndarray, block: np.ndarray, left: np.ndarray) -> None:
        at = (block + 1) << k
        for i in range(k - 1, -1, -1):
            h, step = self.hashes[i].all, 1 << i
            there = at + period < len(h)
            to = np.where(there, at, 0)
            at += step * (there & (h[to] == h[np.where(there, at + period, 0)]))
        end = at + period
        long = end - left >= np.maximum(self.min_exponent * period, self.min_length)
        self.found.append((left[long], end[long], period[long]))

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for k, (period, block, left) in enumerate(self.open):
            self._close(k, period, block, left)
        start, end, period = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        smallest = np.ones(len(start), bool)  # a stretch is caught at each multiple of its period, too
        smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return start[smallest], end[smallest], period[smallest]


def word_runs(words: np.ndarray, longest_text: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
              slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then end; each is compared word by word."""
    seed = 1
    while True:
        catcher = SquareCatcher(longest_text // max(min_exponent, 2), min_length, min_exponent, seed)
        for i in range(0, len(words), slab):
            catcher.append(words[i:i + slab])
        start, end, period = catcher.finish()
        if all(np.array_equal(words[s:e - p], words[s + p:e]) for s, e, p in zip(start, end, period)):
            return start, end, period
        seed += 1000


def planted_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one id in ten: which original word stands at each place, a stretch repeated up to the end of the text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """``runs``: (start, length, period)."""
    runs.sort(key=lambda r: (r[0], r[2]))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept, best = words, (None, None, None, None)
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            dropped[s + p] += 1
            dropped[s + n] -= 1
            if best[0] is None or n * best[2] > best[1] * p:
                best = (s, n, p, 1000 * n // p)
        kept = compress(words, (np.cumsum(dropped) == 0).tolist())
    return (doc_id, len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def _documents(ids: list, texts: list, tail, min_length: int, min_exponent: int, slab: int) -> list[tuple]:
    numbers: dict[bytes, int] = {}
    held, parts = [], []
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        words = (text or b"").split()
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        place = tail(len(words), doc_id)
        if place is not None:
            codes, words = codes[place], [words[j] for j in place]
        held.append(words)
        parts += [codes, np.array([-1 - i])]  # a word of its own ends each text
    longest = max((len(w) for w in held), default=0)
    start, end, period = word_runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), longest, min_length, min_exponent, slab)
    offset = np.cumsum([0] + [len(w) + 1 for w in held])
    of = np.searchsorted(offset, start, "right") - 1
    runs: dict[int, list] = {}
    for d, s, e, p in zip(of.tolist(), (start - offset[of]).tolist(), (end - offset[of]).tolist(), period.tolist()):
        runs.setdefault(d, []).append((s, e - s, p))
    return [_row(doc_id, words, runs.get(i, [])) for i, (doc_id, words) in enumerate(zip(ids, held))]


def run_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tail=lambda n, doc_id: None,
               min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, slab: int = SLAB) -> DataFrame:
    """One row per document: n_words, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli), ``runs_sha256`` of all runs and ``collapsed_sha256`` of the words that stay when each run keeps its
    first period only. ``tail(n, doc_id)`` may name the word that stands at each place (``planted_tail``)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _documents(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tail, min_length, min_exponent, slab)
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
