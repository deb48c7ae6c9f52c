"""Byte-pair encoding through an index of pair occurrences, and decoding.

The different pre-tokens of a slice of rows are laid end to end as symbols. An index maps each pair of neighbours to
all its positions; a heap holds the ranks of the pairs that occur. The smallest rank is applied to all its positions
at once, from left to right; each merge takes the two pairs beside it out of the index and enters the two new ones.
Pre-tokens don't touch each other, so this gives each of them what merging its own lowest rank first gives it, and a
pre-token of a million letters costs as much per letter as a short one. Encoded pre-tokens are kept (up to ``CACHE`` of
them, then all anew), so each costs one look-up afterwards.

Text up to U+00FF is normalised and cut by a pattern of our own; all other text by the normaliser and pre-tokeniser that
the tokeniser's file describes. Special tokens in a text are one id each, as in the library's own encoding.

Edge cases: a null text counts as empty and has no tokens; repeated rows and ids each give their own row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import slices
from transloom.session import ship_package

CACHE = 400_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

#: Pre-tokens of lower-case text up to U+00FF: contractions, letters, single digits, runs of other marks.
_LETTER, _DIGIT = r"a-zªµºß-öø-ÿ", r"0-9²³¹¼-¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r \x85\xa0{_LETTER}{_DIGIT}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class PairIndex:
    """All positions of each pair among the symbols of many words."""

    def __init__(self, words: list[list[int]], merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges, self.symbols, self.at = merges, [], {}
        self.before, self.after, self.first = [], [], []
        for word in words:
            start, n = len(self.symbols), len(word)
            self.first.append(start if n else -1)
            self.symbols += word
            self.before += [i - 1 for i in range(start, start + n)]
            self.after += [i + 1 for i in range(start, start + n)]
            if n:
                self.before[start] = self.after[-1] = -1
        self.ranks: list[tuple[int, tuple[int, int]]] = []
        for i, j in enumerate(self.after):
            if j >= 0:
                self._enter(i, (self.symbols[i], self.symbols[j]))
        heapq.heapify(self.ranks)

    def _enter(self, i: int, pair: tuple[int, int], push: bool = False) -> None:
        rule = self.merges.get(pair)
        if rule is None:
            return
        places = self.at.get(pair)
        if places is None:
            self.at[pair] = {i}
            if push:
                heapq.heappush(self.ranks, (rule[0], pair))
            else:
                self.ranks.append((rule[0], pair))
        else:
            places.add(i)

    def _leave(self, i: int, pair: tuple[int, int]) -> None:
        places = self.at.get(pair)
        if places is not None:
            places.discard(i)

    def merge_all(self) -> None:
        symbols, before, after = self.symbols, self.before, self.after
        while self.ranks:
            _, pair = heapq.heappop(self.ranks)
            places, new = self.at[pair], self.merges[pair][1]
            for i in sorted(places):
                j = after[i]
                if symbols[i] != pair[0] or j < 0 or symbols[j] != pair[1]:
                    continue  # taken by the merge before it, as in a a a
                h, k = before[i], after[j]
                if h >= 0:
                    self._leave(h, (symbols[h], symbols[i]))
                if k >= 0:
                    self._leave(j, (symbols[j], symbols[k]))
                symbols[i], symbols[j], after[i] = new, -1, k
                if h >= 0:
                    self._enter(h, (symbols[h], new), push=True)
                if k >= 0:
                    before[k] = i
                    self._enter(i, (new, symbols[k]), push=True)
            del self.at[pair]

    def words(self) -> Iterator[list[int]]:
        for i in self.first:
            word = []
            while i >= 0:
                word.append(self.symbols[i])
                i = self.after[i]
            yield word


class Tokens:
    """The tokeniser of a file in the ``tokenizers`` format: byte-level BPE with a suffix on each word's last symbol."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        library, spec = Tokenizer.from_str(file), json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("not a byte-pair vocabulary without decoder")
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.marked = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letter = byte_letters()
        self.of_letter = {c: vocab[c] for c in self.letter}
        self.of_last = {c: vocab[c + suffix] for c in self.letter}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.latin: dict[str, tuple[bytes, bytes]] = {}  # text up to U+00FF -> ids, tokens
        self.other: dict[str, tuple[bytes, bytes]] = {}  # byte letters -> the same

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(str, ids)).encode(), " ".join(map(self.names.__getitem__, ids)).encode()

    def _learn(self, cache: dict, new: set[str], letters) -> None:
        new = sorted(new)
        spelt = [letters(w) for w in new]
        index = PairIndex([[*map(self.of_letter.__getitem__, s[:-1]), self.of_last[s[-1]]] for s in spelt], self.merges)
        index.merge_all()
        cache.update(zip(new, map(self._entry, index.words())))

    def _spell(self, pre_token: str) -> str:
        return "".join(map(self.letter.__getitem__, pre_token.encode()))

    def pre_tokens(self, text: str) -> list[tuple[dict, list[str]]]:
        """The pre-tokens of a text with the cache that holds their kind; a special token has its entry at once."""
        out = []
        for part in (self.marked.split(text) if self.marked else [text]):
            if part in self.special:
                i = self.special[part]
                out.append(({part: self._entry([i])}, [part]))
            elif _is_latin(part):
                out.append((self.latin, _LATIN.findall(part.lower())))
            elif part:
                out.append((self.other, [w for w, _ in self.cut(self.normalise(part))]))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids, the ids in decimal, the decoded text."""
        cut = [self.pre_tokens(t) for t in texts]
        for cache, letters in ((self.latin, self._spell), (self.other, str)):
            if len(cache) > CACHE:
                cache.clear()
            new = set().union(*(set(ws).difference(cache) for parts in cut for of, ws in parts if of is cache))
            if new:
                self._learn(cache, new, letters)
        for parts in cut:
            entries = [of[w] for of, ws in parts for w in ws]
            ids, decoded = map(b" ".join, zip(*entries)) if entries else (b"", b"")
            yield ids.count(b" ") + bool(entries), ids, decoded


@lru_cache(maxsize=1)
def _worker_tokens(file: str) -> Tokens:
    """One tokeniser a Python worker: what a task has encoded serves the tasks after it."""
    return Tokens(file)


def encode_report(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens, ``ids_sha256`` of the ids, ``decoded_sha256`` of the text decoded from them.
    ``vocabulary`` is the content of the tokeniser's file (2 MB), read by the driver and broadcast."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(held.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sums = [(n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
                    for n, ids, text in tokens.encode_batch(texts)]
            n, ids, decoded = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
