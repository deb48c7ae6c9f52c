"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is read as eight positional bytes. Two fingerprints that differ in at most ``max_bits`` (2)
bits differ in at most two bytes, so they share at least six positional bytes: the guaranteed minimum. The postings are
keyed by five positions and their bytes (56 choices): a posting on one byte would hold 1/256 of the corpus and
grow with it, a posting on five holds 2^24 fingerprints at most, whatever the corpus, and hardly ever more than a few.
Inside a posting the shared bytes of each pair are tallied; pairs that share no sixth byte are dropped by the count,
the rest are verified by Hamming distance. On 9,296 fingerprints of the test tables, over all postings: keys of one byte give 1,374,300
pairs, of five bytes 88, of six bytes (where no count could drop any) 14.
A posting of more than 64 fingerprints is probed instead: its three free bytes are 24 bits, so each fingerprint
has 300 possible partners there, looked up by binary search.

Equal fingerprints meet before that: one row for each different fingerprint goes on, so a group of thousands of
copies costs one row. A fingerprint has at most 2,080 neighbours, so links grow in proportion to the rows.

Edge cases: a text with no word (null, empty, blank) has fingerprint zero and is linked like any other; with fewer
words than a shingle, the whole sequence is the one shingle; repeated rows and ids share the component; a null id
never names a component unless all ids in it are null; an empty table gives no rows; other columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import cut, slices
from transloom.llm.components import components
from transloom.session import ship_package

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
NO_ID = (1 << 63) - 1
_SLAB = 1 << 16  # shingles whose bits are summed at a time

#: Positional bytes that key a posting, and those that a pair within two bits shares.
KEY_BYTES, MIN_SHARED = 5, 6
#: The 56 choices of five byte positions, as 64-bit masks; bit k of a name is position k.
CHOICES = [sum(1 << p for p in c) for c in combinations(range(8), KEY_BYTES)]
MASKS = [sum(0xFF << 8 * p for p in range(8) if name >> p & 1) for name in CHOICES]
#: For each set of equal positions, the first choice inside it: a pair is reported there only.
FIRST = np.array([next((i for i, c in enumerate(CHOICES) if c & same == c), -1) for same in range(256)])


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _SLAB):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i:i + _SLAB]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, rid, fp): rid is a hash of the text, fp the fingerprint as a signed 64-bit number."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "rid", "fp"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid"),
                       F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, rid bigint, fp bigint")


def _verified(a: np.ndarray, b: np.ndarray, choice: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share at least the guaranteed number of positional bytes, at their first common choice, within
    ``max_bits``."""
    x = a ^ b
    equal = x.view(np.uint8).reshape(-1, 8) == 0
    tally = equal.sum(axis=1)
    same = equal @ (1 << np.arange(8))
    ok = (tally >= MIN_SHARED) & (FIRST[same] == choice) & (np.bitwise_count(x) <= max_bits)
    return a[ok], b[ok]


def _probe(fps: np.ndarray, choice: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A large posting: look each possible partner up among the free bits."""
    free = [p for p in range(8) if not CHOICES[choice] >> p & 1]
    low = np.zeros(len(fps), np.int64)
    for i, p in enumerate(free):
        low |= ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << 8 * i
    order = np.argsort(low)
    fps, low = fps[order], low[order]  # each once: a posting's fingerprints differ in their free bytes
    a, b = [], []
    for k in range(1, max_bits + 1):
        for bits in combinations(range(8 * len(free)), k):
            wanted = low ^ sum(1 << i for i in bits)
            at = np.minimum(np.searchsorted(low, wanted), len(low) - 1)
            hit = np.flatnonzero((low[at] == wanted) & (at > np.arange(len(low))))
            a.append(fps[hit])
            b.append(fps[at[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    return _verified(a, b, np.full(len(a), choice), max_bits)


def _postings(batches: Iterable[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by choice and posting key; emits links. A posting that goes on in the next batch waits."""
    wait = None

    def links(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[start, len(c)])
        group = np.repeat(np.arange(len(start)), size)
        small = size[group] <= 64
        found = [_probe(fp[s:s + n], int(c[s]), max_bits) for s, n in zip(start, size) if n > 64]
        cs, gs, fs = c[small], group[small], fp[small]
        for d in range(1, int(size[size <= 64].max(initial=0))):
            pair = np.flatnonzero(gs[d:] == gs[:-d])
            if not len(pair):
                break
            found.append(_verified(fs[pair], fs[pair + d], cs[pair], max_bits))
        if not found:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        return pd.DataFrame({"u": np.concatenate([f[0] for f in found]).view(np.int64),
                             "v": np.concatenate([f[1] for f in found]).view(np.int64)})

    for pdf in batches:
        if wait is not None:
            pdf = pd.concat([wait, pdf], ignore_index=True)
        c, key, fp = pdf["choice"].to_numpy(), pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        if not len(c):
            continue
        last = int(np.flatnonzero((c != c[-1]) | (key != key[-1])).max(initial=-1)) + 1
        wait = pdf.iloc[last:]
        if last:
            yield links(c[:last], key[:last], fp[:last])
    if wait is not None and len(wait):
        yield links(wait["choice"].to_numpy(), wait["key"].to_numpy(), wait["fp"].to_numpy().view(np.uint64))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): each pair of different fingerprints at most ``max_bits`` apart, once. ``fps`` holds each ``fp`` once."""
    if not 0 <= max_bits <= 2:
        raise ValueError("six shared positional bytes are guaranteed for at most 2 bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
    postings = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    return postings.mapInPandas(lambda it: _postings(it, max_bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, rid, fp, component_id (the smallest id reachable over links)."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints["fp"] == named["__fp"], "left").select("doc_id", "rid", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id (then the smallest text hash)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    # the largest id stands for a null one, so that the join and the removal of repeated rows share one shuffle
    keep = found.groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "rid")).alias("k")) \
        .select(F.col("k.d").alias("__doc"), F.col("k.rid").alias("__rid"))
    keyed = docs.withColumns({"__d": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)),
                              "__r": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    one = keyed.join(keep, (F.col("__d") == F.col("__doc")) & (F.col("__r") == F.col("__rid")), "left_semi")
    return one.dropDuplicates(["__d", "__r"]).select(*docs.columns)
