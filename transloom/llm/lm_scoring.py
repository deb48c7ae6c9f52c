"""Language-model scoring by deleted interpolation.

A text's tokens are its words and one end token. The probability of a token after its context is a mixture of the
maximum-likelihood estimates of all n-gram lengths up to ``order`` and the uniform one. The weights depend on how
often the longest context was seen (buckets by powers of two). They are learned by expectation-maximisation: one
fold of the training documents is deleted from the counts, and the weights are those that make it most probable. The
scores then use the counts of all training documents.

Documents are dealt by hash into blocks. A block sends each different n-gram once, as a 64-bit hash with its counts,
to the range of hashes it belongs to; there the blocks' counts are summed and the sums go back, in the same order, to
the blocks that asked. So a frequent n-gram costs one number per block, not one per occurrence, and no task holds
more than a block or a range; both have a fixed size and their number follows the input (a text that is longer than a
block is a block of its own). Repeated rows are told once, with their number (``once_each``), and counted and scored as
often. What EM needs is tallied
into cells (bucket, logarithms of the estimates in steps of 1/8), a table bounded by the grid, not by the corpus; only
that reaches the driver. The weights are fitted on the cells' centres, the scores are computed from exact counts.

Hashes of 64 bits stand for tokens and n-grams: two of n different ones meet with a probability of about
n * n / 2^65, 3e-6 for ten million tokens.

Edge cases: null counts as empty; an empty text is the end token alone; repeated rows are counted and scored row by
row; a null id belongs to the training part; without training documents every token has probability 1 (one unknown
type); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import cut, once_each, pieces, width
from transloom.session import ship_package

ORDER = 2
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20
#: Cells per factor of two in the tally for EM.
GRID = 8
EM_ROUNDS = 200
EM_STOP = 1e-7
BUCKETS = 24
#: Least weight of the uniform estimate.
LEAST = 1e-6

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def tokens(text: str | None) -> list[bytes]:
    """Words, then the end token (the empty string, which no word equals)."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of (a, b): a multiply-xorshift mix of 64 bits."""
    x = (a ^ (a >> np.uint64(29))) * _MIX[0] + b * _MIX[1]
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


class Block:
    """The n-grams of some documents: ``asked`` holds the hash of each different one in order, ``places[k]`` where
    the (k + 1)-gram that ends at each token stands in it."""

    def __init__(self, texts: Iterable[str | None], order: int):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        codes = [np.fromiter(map(ids.__getitem__, tokens(t)), np.int32) for t in texts]  # a text's words go after it is read
        self.sizes = np.array([len(c) for c in codes], np.int64)
        n = int(self.sizes.sum())
        word = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
        names = [np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in ids), np.uint64, len(ids))]
        at = [word]
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        for k in range(1, order):
            pad, n_words = len(names[-1]), len(names[0])
            before = np.r_[pad, at[-1][:-1]] if n else at[-1]
            before[first] = pad  # a text's start
            found, pairs = pd.factorize(before * n_words + word)
            names.append(_mixed(np.r_[names[-1], np.uint64(k)][pairs // n_words], names[0][pairs % n_words] + np.uint64(k)))
            at.append(found.astype(np.int64))
        self.n_tokens = len(names[0])
        every = np.concatenate(names)
        self.by_hash = np.argsort(every)
        self.asked = every[self.by_hash]
        rank = np.empty(len(every), np.int64)
        rank[self.by_hash] = np.arange(len(every))
        starts = np.cumsum([0, *map(len, names)])
        self.places = [rank[starts[k] + at[k]] for k in range(order)]

    def is_token(self) -> np.ndarray:
        return self.by_hash < self.n_tokens

    def tally(self, times: np.ndarray) -> np.ndarray:
        """Occurrences of each different n-gram, each document counted so many times."""
        on = np.repeat(times, self.sizes)
        return sum(np.bincount(p, on, len(self.asked)) for p in self.places).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, all first bytes first, then all second bytes and so on."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of each hash, 0 to n - 1; n is a power of two."""
    return (keys >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)


def _asker(order: int, n_ranges: int):
    """A block's documents -> its n-grams by range of hashes: the hashes (as differences), how often training documents
    hold them, how often deleted ones do, and which are single tokens."""
    def run(docs: pa.Table) -> pa.Table:
        held = Block(docs["text"].to_pylist(), order)
        copies = docs["copies"].to_numpy()
        n_all = held.tally(docs["trains"].to_numpy() * copies)
        n_del = held.tally(docs["deleted"].to_numpy() * copies)
        token = held.is_token()
        edges = np.searchsorted(_ranges(held.asked, n_ranges), np.arange(n_ranges + 1))
        parts = np.flatnonzero(np.diff(edges))
        cut_up = lambda x: pa.array([packed(x[edges[p]:edges[p + 1]]) for p in parts], pa.binary())
        steps = np.r_[held.asked[:1], np.diff(held.asked)]
        steps[edges[:-1][np.diff(edges) > 0]] = held.asked[edges[:-1][np.diff(edges) > 0]]
        return pa.table({"part": pa.array(parts, pa.int64()), "block": pa.array([docs["block"][0].as_py()] * len(parts), pa.int64()),
                         "grams": cut_up(steps.view(np.int64)), "n_all": cut_up(n_all), "n_del": cut_up(n_del),
                         "is_token": cut_up(token)})
    return run


_ASKED = "part bigint, block bigint, grams binary, n_all binary, n_del binary, is_token binary"
_TOLD = "block bigint, part bigint, n_all binary, n_del binary, tokens bigint, types bigint, kept_tokens bigint"


def _summed(asked: pa.Table) -> pa.Table:
    """All requests for one range of hashes -> the same requests with the sums over all blocks, and one row (of a
    negative block) with the range's training tokens and types."""
    each = [np.cumsum(unpacked(x).view(np.uint64), dtype=np.uint64) for x in asked["grams"].to_pylist()]
    edges = np.cumsum([0, *map(len, each)])
    where, grams = pd.factorize(np.concatenate(each))
    del each
    add = lambda c: np.bincount(where, np.concatenate([unpacked(x) for x in asked[c].to_pylist()]), len(grams)).astype(np.int64)
    n_all, n_del, token = add("n_all"), add("n_del"), add("is_token") > 0
    part, n = asked["part"][0].as_py(), asked.num_rows
    own = lambda x: pa.array([0] * n + [int(x)], pa.int64())
    back = lambda x: pa.array([*(packed(x[where[a:b]]) for a, b in zip(edges[:-1], edges[1:])), None], pa.binary())
    return pa.table({"block": pa.array([*asked["block"].to_pylist(), -1 - part % 1024], pa.int64()),
                     "part": pa.array([part] * (n + 1), pa.int64()), "n_all": back(n_all), "n_del": back(n_del),
                     "tokens": own(n_all[token].sum()), "types": own((n_all[token] > 0).sum()),
                     "kept_tokens": own((n_all - n_del)[token].sum())})


#: Documents in a row of the table of counts.
ROW_DOCS = 256


def _counted(order: int) -> str:
    return ", ".join(["doc_id array<bigint>, held_out array<boolean>, copies array<bigint>, deleted boolean, sizes binary",
                      *(f"c{k} binary" for k in range(order)), *(f"d{k} binary" for k in range(order)),
                      "tokens bigint, types bigint, kept_tokens bigint"])


def _answered(order: int):
    """A block's documents and the sums that it asked for -> rows of some documents each: their ids and sizes, the
    counts of their n-grams of each length (c), and for deleted documents the counts without the deleted fold (d)."""
    names = ["doc_id", "held_out", "copies", "deleted", "sizes", *(f"c{k}" for k in range(order)), *(f"d{k}" for k in range(order))]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.bool_(), *[pa.binary()] * (2 * order + 1)]

    def table(rows: list[tuple], totals: pa.Table | None) -> pa.Table:
        cols = list(zip(*rows)) or [()] * len(names)
        out = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
        for c in ("tokens", "types", "kept_tokens"):
            out[c] = totals[c] if totals is not None else pa.array([0] * len(rows), pa.int64())
        return pa.table(out)

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:  # the ranges' own totals
            return table([(None,) * len(names)] * told.num_rows, told)
        held = Block(docs["text"].to_pylist(), order)
        told = told.sort_by("part")
        sums, less = (np.concatenate([unpacked(x) for x in told[c].to_pylist()]) for c in ("n_all", "n_del"))
        kept = sums - less
        ids, held_out, copies = (docs[c].to_pylist() for c in ("doc_id", "held_out", "copies"))
        deleted = docs["deleted"].to_numpy()
        starts = np.cumsum(held.sizes) - held.sizes
        rows = []
        for gone in (False, True):
            same = np.flatnonzero(deleted == gone)
            for i in range(0, len(same), ROW_DOCS):
                part = same[i:i + ROW_DOCS]
                at = np.concatenate([np.arange(starts[j], starts[j] + held.sizes[j]) for j in part])
                places = [p[at] for p in held.places]
                rows.append(([ids[j] for j in part], [held_out[j] for j in part], [copies[j] for j in part], gone, packed(held.sizes[part]),
                             *(packed(sums[p]) for p in places), *(packed(kept[p]) if gone else None for p in places)))
        return table(rows, None)
    return run


def _unpacked(row: dict, kind: str, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(counts of each length over a row's documents, edges of the documents)."""
    return [unpacked(row[f"{kind}{k}"]) for k in range(order)], np.r_[0, np.cumsum(unpacked(row["sizes"]))]


def _estimates(counts: list[np.ndarray], edges: np.ndarray, texts: int, total: int,
               types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates of length 0..order, whether each has a context that was seen, count of the longest context) of each token."""
    n = len(counts[0])
    p, usable = np.zeros((len(counts) + 1, n)), np.ones((len(counts) + 1, n), bool)
    p[0] = 1.0 / (types + 1)
    starts = edges[:-1][np.diff(edges) > 0]
    for k, seen in enumerate(counts):
        context = np.full(n, total, np.int64)
        if k and n:  # the count of the n-gram one shorter, one place before; a text's start was seen once in each text
            context[1:] = counts[k - 1][:-1]
            context[starts] = texts
        usable[k + 1] = context > 0
        np.divide(seen, context, out=p[k + 1], where=context > 0)
    return p, usable, context


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then by powers of two."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1).astype(np.int64)


#: The step of an estimate of zero. Steps lie between it and its negative: estimates within a factor of 2 ** 127 of the uniform one.
NEVER = -1_024


def _cells(batches: Iterable[pa.RecordBatch], texts: int, total: int, types: int, order: int) -> Iterator[pa.RecordBatch]:
    """Tally of cells over the deleted documents of a partition. A cell is one number: the bucket, then for each
    estimate log2 of its ratio to the uniform one, in steps, 11 bits each."""
    tally: dict[int, int] = defaultdict(int)
    for row in (r for batch in batches for r in batch.to_pylist()):
        counts, edges = _unpacked(row, "d", order)
        p, _, context = _estimates(counts, edges, texts, total, types)
        cell = _bucket(context)
        for k in range(1, order + 1):
            step = np.full(len(context), NEVER)
            seen = p[k] > 0
            step[seen] = np.clip(np.round(GRID * np.log2(p[k][seen] / p[0][seen])), NEVER + 1, -NEVER - 1)
            cell = cell << 11 | (step - NEVER).astype(np.int64)
        found, at = np.unique(cell, return_inverse=True)
        times = np.bincount(at, np.repeat(np.array(row["copies"], np.int64), np.diff(edges)), len(found)).astype(np.int64)
        for c, n in zip(found.tolist(), times.tolist()):
            tally[c] += n
    yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.int64()), pa.array(tally.values(), pa.int64())], names=["cell", "n"])


def cell_of(cell: int, order: int) -> tuple[int, list[int]]:
    """(bucket, steps) of a cell's number."""
    return cell >> 11 * order, [(cell >> 11 * (order - k) & 2047) + NEVER for k in range(1, order + 1)]


def fit_weights(cells: list[tuple[int, list[int], int]], order: int) -> np.ndarray:
    """Mixture weights (BUCKETS, order + 1) by EM; a bucket without held-out counts takes those of the bucket below."""
    weights = np.zeros((BUCKETS, order + 1))
    for b in range(BUCKETS):
        own = [(s, n) for k, s, n in cells if k == b]
        w = weights[b - 1] if b > 1 else np.full(order + 1, 1.0 / (order + 1))
        if own:
            steps, n = np.array([s for s, _ in own], float), np.array([n for _, n in own], float)
            ratio = np.c_[np.ones(len(own)), np.where(steps <= NEVER, 0.0, np.exp2(np.maximum(steps, NEVER + 1) / GRID))]
            w, last = np.full(order + 1, 1.0 / (order + 1)), -np.inf
            for _ in range(EM_ROUNDS):
                mixed = ratio * w
                total = mixed.sum(axis=1)
                likely = float((n * np.log(total)).sum() / n.sum())
                w = (mixed / total[:, None] * n[:, None]).sum(axis=0) / n.sum()
                if likely - last < EM_STOP:
                    break
                last = likely
        w = np.maximum(w, np.r_[LEAST, np.zeros(order)])  # a token never seen keeps some probability
        weights[b] = w / w.sum()
    return weights


def _scored(batches: Iterable[pa.RecordBatch], weights: np.ndarray, texts: int, total: int, types: int,
            order: int) -> Iterator[pa.RecordBatch]:
    for row in (r for batch in batches for r in batch.to_pylist()):
        counts, edges = _unpacked(row, "c", order)
        p, usable, context = _estimates(counts, edges, texts, total, types)
        w = weights[_bucket(context)].T * usable  # weights of estimates without a context go to the others
        score = np.log10((w * p).sum(axis=0) / w.sum(axis=0))
        base = np.log10((counts[0] + 1) / (total + types + 1))
        per_text = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  each text has a token
        one = pa.RecordBatch.from_arrays(
            [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(np.diff(edges).astype(np.int64)),
             pa.array(per_text((counts[0] > 0).astype(np.int64))), pa.array(per_text(base)), pa.array(per_text(score))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        for i, n in enumerate(row["copies"]):
            if n > 1:
                yield from _again(one.slice(i, 1), n - 1)
        yield one


def _again(row: pa.RecordBatch, times: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, times, 10_000):
        yield row.take(pa.array(np.zeros(min(10_000, times - at), np.int64)))


MAX_ORDER = 5  # a cell's number has 11 bits for each length


def score_documents(docs: DataFrame, *, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text",
                    order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents that aren't ``held_out``; its weights from those of them that are ``deleted``.
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 1 to {MAX_ORDER}")
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       held_out.alias("held_out"), (~held_out).alias("trains"), (~held_out & deleted).alias("deleted"))
    size, texts, gone = rows.agg(F.sum(F.octet_length("text").cast("bigint") + 8), F.count(F.when(F.col("trains"), 1)),
                                 F.count(F.when(F.col("deleted"), 1))).first()
    n_blocks = pieces(size or 0, BLOCK_BYTES)
    n_ranges = 1 << (pieces(size or 0, RANGE_BYTES) - 1).bit_length()
    once = once_each(rows.withColumn("rid", F.xxhash64("text")), ["doc_id", "rid", "held_out", "deleted"], "repeated")
    dealt = once.withColumn("block", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_blocks))).drop("rid") \
        .repartition(width(spark, n_blocks), "block")
    asked = dealt.groupBy("block").applyInArrow(_asker(order, n_ranges), _ASKED)
    told = asked.repartition(width(spark, n_ranges), "part").groupBy("part").applyInArrow(_summed, _TOLD)
    counted = cut(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_answered(order), _counted(order)), "counts")
    total, types, kept = (int(x or 0) for x in counted.agg(F.sum("tokens"), F.sum("types"), F.sum("kept_tokens")).first())
    cells = counted.where(F.col("deleted")).select("sizes", "copies", *[f"d{k}" for k in range(order)]).mapInArrow(
        lambda it: _cells(it, texts - gone, kept, types, order), "cell bigint, n bigint")
    tallied = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # bounded by the grid
    weights = fit_weights(sorted((*cell_of(r["cell"], order), r["n"]) for r in tallied), order)
    scored = counted.where(F.col("deleted").isNotNull()).select("doc_id", "held_out", "sizes", "copies", *[f"c{k}" for k in range(order)]).mapInArrow(
        lambda it: _scored(it, weights, texts, total, types, order),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
