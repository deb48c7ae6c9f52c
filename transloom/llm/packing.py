"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document's tokens and one end token are one item; a longer one is cut into full sequences, its first piece taking
the rest. Full pieces are sequences of their own. The other pieces are dealt by hash into blocks of about
``block_items``; a block is a packing problem of its own, large enough that its waste is a small part of a
percent. Each block is evolved on several islands, which are separate tasks: a chromosome is a list of whole bins; the
crossover injects well-filled bins of one parent into the other, removes the bins that now hold a document twice,
and best-fits the displaced documents. Between epochs each island's elite also moves to the next island (a
shuffle on block and island). A block stops when it meets its lower bound. Then documents from bins that stayed badly
filled in any block meet in new blocks for another round, so that no block's last bins stay half empty.

Blocks are bounded by construction, so no task grows with the corpus; pieces move as (id, length) only.

Edge cases: a null or empty text is the end token alone; repeated rows are packed row by row; equal lengths are taken
in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import cut, pieces, slices, width
from transloom.session import ship_package

CAPACITY = 2_048
END_ID = 0
BLOCK_ITEMS = 4_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 8
#: Documents of bins filled less than this go to the next round.
WELL_FILLED = 0.97
ROUNDS = 2
#: Cached pre-tokens in a task.
CACHE = 400_000

# The vocabulary's pre-tokenizer for Latin-1 text, its letter, number and space classes spelled out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Encoder(dict):
    """Text to token ids, as little-endian unsigned 32-bit bytes. Latin-1 text goes pre-token by pre-token through a
    cache, new pre-tokens being merged by the vocabulary's rank file; any other text, and text that spells a special
    token, goes to the tokenizer whole."""

    def __init__(self, vocabulary: str, ranks: bytes):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, pre_token: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[pre_token] = np.array(self.merge(pre_token), "<u4").tobytes()
        return ids

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode_whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.encode_whole(text)
        return b"".join(map(self.__getitem__, _LATIN.findall(text)))


def token_pieces(docs: DataFrame, vocabulary: tuple[str, bytes], *, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): each document's pieces in order."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(*held.value), END_ID.to_bytes(4, "little")
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    out.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, piece = at + size, piece + 1
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return found.withColumn("uid", F.monotonically_increasing_id())


class Problem:
    """One block: item sizes, and the operations on chromosomes (lists of bins, a bin being a list of items)."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.random = sizes, capacity, random.Random(seed)
        self.order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
        self.bound = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))

    def fill(self, content: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, content))

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Each item goes to the bin with the least room that holds it. ``open_bins`` lists bins by room, and the set
        bits of ``rooms`` tell which lists are not empty."""
        open_bins: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for i, content in enumerate(bins):
            room = self.capacity - self.fill(content)
            open_bins[room].append(i)
            rooms |= 1 << room
        for item in items:
            size = self.sizes[item]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                i = open_bins[room].pop()
                if not open_bins[room]:
                    rooms ^= 1 << room
                bins[i].append(item)
            else:
                room, i = self.capacity, len(bins)
                bins.append([item])
            open_bins[room - size].append(i)
            rooms |= 1 << (room - size)
        return bins

    def seeded(self, jitter: float) -> list[list[int]]:
        """Best fit by decreasing size, the sizes blurred by ``jitter``."""
        if not jitter:
            return self.best_fit([], self.order)
        return self.best_fit([], sorted(self.order, key=lambda i: -self.sizes[i] * (1 + jitter * self.random.random())))

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def crossover(self, one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
        """Whole well-filled bins of ``other`` go into ``one``; bins of ``one`` that now repeat an item are opened and
        their other items, with those of the two emptiest bins, are best-fitted."""
        ranked = sorted(other, key=self.fill, reverse=True)
        share = self.random.uniform(0.2, 0.6)
        injected = [list(b) for b in ranked[:max(1, int(share * len(ranked)))]]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced.extend(i for i in b if i not in taken)
        kept.sort(key=self.fill, reverse=True)
        for b in kept[-2:]:
            displaced.extend(b)
        del kept[-2:]
        displaced.sort(key=self.sizes.__getitem__, reverse=True)
        return self.best_fit(injected + kept, displaced)

    def evolve(self, arrived: list[list[list[int]]], population: int, crossovers: int) -> list[list[int]]:
        """The best chromosome after one epoch. Without arrivals the island is seeded."""
        now = [[list(b) for b in c] for c in arrived] or [self.seeded(0)]
        best = max(now, key=self.fitness)
        if len(best) <= self.bound:
            return best
        while len(now) < population:
            now.append(self.seeded(0.1))
        now.sort(key=self.fitness, reverse=True)
        for _ in range(crossovers):
            if len(now[0]) <= self.bound:
                break
            one, other = self.random.sample(range(len(now)), 2)
            child = self.crossover(now[one], now[other])
            if self.fitness(child) > self.fitness(now[-1]):
                now[-1] = child
                now.sort(key=self.fitness, reverse=True)
        return now[0]


_STATE = "block bigint, island int, sizes array<int>, uids array<bigint>, bin_of array<int>, n_bins int, squares double"


def _bins(bin_of: Iterable[int]) -> list[list[int]]:
    content: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        content.setdefault(int(b), []).append(i)
    return list(content.values())


def _evolver(capacity: int, population: int, crossovers: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        sizes = [int(s) for s in pdf["sizes"].iloc[0]]
        problem = Problem(sizes, capacity, hash((block, island, epoch)))
        best = problem.evolve([_bins(b) for b in pdf["bin_of"] if b is not None], population, crossovers)
        bin_of = [0] * len(sizes)
        for k, content in enumerate(best):
            for i in content:
                bin_of[i] = k
        count, squares = problem.fitness(best)
        return pd.DataFrame({"block": [block], "island": [island], "sizes": [sizes], "uids": [pdf["uids"].iloc[0]],
                             "bin_of": [bin_of], "n_bins": [-count], "squares": [squares]})
    return run


def evolve_blocks(items: DataFrame, n_blocks: int, *, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS,
                  population: int = POPULATION, crossovers: int = CROSSOVERS) -> DataFrame:
    """(uid, length) -> (uid, length, sequence_id, offset, filled): the best chromosome of each block."""
    n = width(items.sparkSession, min(n_blocks * islands, 100_000))
    blocks = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    state = blocks.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"),
                          F.col("x.length").cast("array<int>").alias("sizes"), F.col("x.uid").alias("uids"),
                          F.lit(None).cast("array<int>").alias("bin_of"), F.lit(None).cast("int").alias("n_bins"),
                          F.lit(None).cast("double").alias("squares"))
    for epoch in range(epochs):
        if epoch:  # elites migrate around the ring
            on = F.explode(F.array_distinct(F.array(F.col("island"), (F.col("island") + 1) % islands)))
            state = state.withColumn("island", on)
        state = state.repartition(n, "block", "island").groupBy("block", "island").applyInPandas(
            _evolver(capacity, population, crossovers, epoch), _STATE)
    best = state.groupBy("block").agg(F.max_by(F.struct("sizes", "uids", "bin_of"), F.struct(
        -F.col("n_bins"), "squares", -F.col("island"))).alias("b")).select("b.*")

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sizes, uids, bin_of in zip(pdf["sizes"], pdf["uids"], pdf["bin_of"]):
                for content in _bins(bin_of):
                    name, filled = int(uids[content[0]]), int(sum(sizes[i] for i in content))
                    at = 0
                    for i in content:
                        out.append((int(uids[i]), int(sizes[i]), name, at, filled))
                        at += int(sizes[i])
            yield pd.DataFrame(out, columns=["uid", "length", "sequence_id", "offset", "filled"])

    return best.mapInPandas(place, "uid bigint, length bigint, sequence_id bigint, offset bigint, filled bigint")


def pack(items: DataFrame, *, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, rounds: int = ROUNDS,
         **options) -> DataFrame:
    """(uid, length) with unique uids and lengths up to ``capacity`` -> (uid, sequence_id, offset)."""
    ship_package(items.sparkSession)
    done = items.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"),
                                                           F.lit(0).cast("bigint").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    for turn in range(rounds):
        count = rest.count()
        if not count:
            break
        packed = cut(evolve_blocks(rest, pieces(count, block_items), capacity=capacity, **options), "packed")
        last = turn == rounds - 1 or count <= block_items
        settled = packed if last else packed.where(F.col("filled") >= WELL_FILLED * capacity)
        done = done.unionByName(settled.select("uid", "sequence_id", "offset"))
        if last:
            break
        rest = packed.where(F.col("filled") < WELL_FILLED * capacity).select("uid", "length")
    return done


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, ranks_path: str | None = None, *,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The paths name a tokenizer's file and the same vocabulary as ranks; both are read on the driver (3 MB) and broadcast.
    """
    if vocabulary_path is None or ranks_path is None:
        import public_tokenizers

        vocabulary_path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(vocabulary_path, encoding="utf-8") as f, open(ranks_path, "rb") as g:
        vocabulary = f.read(), g.read()
    found = cut(token_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    placed = pack(found.select("uid", "length"), capacity=capacity, **options).withColumnRenamed("uid", "__uid")
    return found.join(placed, found["uid"] == placed["__uid"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
