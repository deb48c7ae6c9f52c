"""Merkle manifest of a dataset, with a witness for each row.

Each row is a leaf. The leaves of a group ascend by id; every three neighbours become one node until one node, the
group's subroot, is left; the subroots, ordered by group, become the root in the same way. A witness holds the siblings
of a row's path up to the root, level by level, so that the row alone can be checked against the root.

Witnesses grow as leaves are appended (``Witnesses``): when the siblings of an open run are complete, the witnesses
below each of them get the others, and the parent is appended to the level above. Rows are numbered in order by one
range-partitioned sort (sums per partition and group give the offsets, so no group is gathered), then cut into
aligned blocks of 3^6 rows (``levels``). A block is a subtree of its own: its rows get their partial witnesses, its root
is appended as a node of the next round, whose witnesses extend those of all rows below. The rounds grow with the
logarithm of the largest group (four for 10^10 rows). A row's witness is written once and extended by a join on
(group, block), which holds at most 729 rows a key.

Edge cases: a null group comes first and is a group of its own, a null id comes first in its group, rows of one id are
ordered by their hash, so repeated rows are equal neighbours; null and empty text differ ('-' and '0:'); other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import cut, pieces, slices, width
from transloom.session import ship_package

ARITY = 3
LEVELS = 6  # of a block, which has 3^6 = 729 rows
ROWS = 200_000  # of a range of sorted leaves

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_bytes(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_bytes, values)).cast("binary"), 256)


def node_hash(children: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


class Witnesses:
    """Leaves are appended; each keeps the siblings on its path, as far as they are complete.

    ``shapes[i]`` has one byte a level: how many siblings are to the left, times 16, plus how many to the right;
    ``siblings[i]`` has them from left to right."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.open = arity, [[]]  # of each level: the nodes of its open run, (hash, leaves below)
        self.shapes: list[bytearray] = []
        self.siblings: list[list[bytes]] = []

    def append(self, leaf: bytes) -> None:
        node = (leaf, [len(self.shapes)])
        self.shapes.append(bytearray())
        self.siblings.append([])
        level = 0
        while node is not None:
            self.open[level].append(node)
            node = self._close(level) if len(self.open[level]) == self.arity else None
            level += 1

    def _close(self, level: int) -> tuple[bytes, list[int]]:
        """The run of this level is complete: extend the witnesses below, give the parent."""
        run, self.open[level] = self.open[level], []
        if level + 1 == len(self.open):
            self.open.append([])
        for j, (_, leaves) in enumerate(run):
            shape, others = j << 4 | len(run) - 1 - j, [h for k, (h, _) in enumerate(run) if k != j]
            for leaf in leaves:
                self.shapes[leaf].append(shape)
                self.siblings[leaf] += others
        return node_hash(h for h, _ in run), [leaf for _, leaves in run for leaf in leaves]

    def finish(self, levels: int) -> bytes:
        """Close what is open up to a height of ``levels``; the node there."""
        for level in range(levels):
            if self.open[level]:
                parent = self._close(level)
                self.open[level + 1].append(parent)
        return self.open[levels][0][0]


def height(n: int, arity: int = ARITY) -> int:
    """Levels until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def fold(leaf: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    at = 0
    for s in shape:
        left, right = at + 32 * (s >> 4), at + 32 * ((s >> 4) + (s & 15))
        parts = [siblings[i:i + 32] for i in range(at, left, 32)] + [leaf] + [siblings[i:i + 32] for i in range(left, right, 32)]
        leaf, at = node_hash(parts), right
    return leaf


def numbered(nodes: DataFrame, order: list[Column], total: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``pos`` from 0 within their ``tree``, rows (tree, n)); trees follow each other in the sort.

    ``monotonically_increasing_id`` counts the sorted rows of a partition; first number and count of each (partition,
    tree) give the offsets."""
    keys = [F.col("tree").asc(), *order]
    spark = nodes.sparkSession
    dealt = nodes.repartitionByRange(width(spark, pieces(total, ROWS)), *keys).sortWithinPartitions(*keys)
    kept = cut(dealt.withColumns({"part": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}), label)
    ends = kept.groupBy("tree", "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    placed = kept.join(ends.select("tree", "part", "offset"), ["tree", "part"]) \
        .select(*nodes.columns, (F.col("mid") + F.col("offset")).alias("pos"))
    return placed, ends.groupBy("tree").agg(F.sum("rows").alias("n"))


def _block_witnesses(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """One block, in order: its rows with their partial witnesses, and one row more with ``pos`` null for its root."""
    pdf = pdf.sort_values("pos")
    grown = Witnesses()
    for h in pdf["hash"]:
        grown.append(bytes(h))
    whole = int(pdf["n"].iloc[0])
    root = grown.finish(height(whole) if whole <= ARITY ** levels else levels)
    out = pdf[["tree", "block", "pos", "hash", "carried"]].assign(shape=[bytes(s) for s in grown.shapes],
                                                                   siblings=[b"".join(s) for s in grown.siblings])
    end = pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "block": [pdf["block"].iloc[0]], "pos": [None], "hash": [root],
                        "carried": [None], "shape": [b""], "siblings": [b""]})
    out["pos"] = out["pos"].astype("Int64")
    end["pos"] = end["pos"].astype("Int64")
    return pd.concat([out, end], ignore_index=True)


_ROUND = "tree string, block bigint, pos bigint, hash binary, carried binary, shape binary, siblings binary"


def grow(nodes: DataFrame, sizes: DataFrame, largest: int, label: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of aligned appends over (tree, pos, hash, carried): the nodes of each round with their partial witnesses
    and, of each tree, the last root as (tree, hash)."""
    rounds, block = [], ARITY ** levels
    while True:
        blocks = nodes.join(sizes, "tree").withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
        done = cut(blocks.groupBy("tree", "block").applyInPandas(lambda pdf: _block_witnesses(pdf, levels), _ROUND), f"{label}-{len(rounds)}")
        rounds.append(done.where(F.col("pos").isNotNull()))
        roots = done.where(F.col("pos").isNull()).select("tree", F.col("block").alias("pos"), "hash",
                                                         F.lit(None).cast("binary").alias("carried"))
        largest = -(-largest // block)
        if largest <= 1:
            return rounds, roots.select("tree", "hash")
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / block).cast("bigint"))
        nodes = roots


def _extended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Rows of the first round with the siblings up to the top. ``tops``: (tree, top columns, shape, siblings)."""
    above = tops.withColumn("at", F.lit(0).cast("bigint"))
    extra = [c for c in tops.columns if c not in ("tree", "shape", "siblings")]
    for done in reversed(rounds):
        up = above.select("tree", F.col("at").alias("block"), *extra, F.col("shape").alias("up_shape"),
                          F.col("siblings").alias("up_siblings"))
        above = done.join(up, ["tree", "block"]).select(
            "tree", F.col("pos").alias("at"), *extra, "hash", "carried", F.concat("shape", "up_shape").alias("shape"),
            F.concat("siblings", "up_siblings").alias("siblings"))
    return above


_RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        out = []
        for carried, leaf, shape, siblings, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
            doc_id, other = carried[:-32], carried[-32:]
            folded = fold(other, shape, siblings)
            out.append((int(doc_id) if doc_id else None, leaf.hex(), subroot.hex(), root.hex(),
                        hashlib.sha256(siblings.hex().encode()).hexdigest(), folded.hex(), folded == root))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=[c.split()[0] for c in _RESULT.split(", ")])


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple = FIELDS,
             shown: Callable[[Column], Column] | None = None, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, ``proof_sha256`` of the siblings on its path, the root folded from the
    row as it is shown, and whether that is the root. ``shown`` gives the text as a reader would hand it in (default: as
    it is); leaves, siblings and root are always of the rows as they are."""
    spark = docs.sparkSession
    ship_package(spark)
    values = {c: F.col(c) for c in fields}
    leaf = row_hash(list(values.values()))
    other = leaf if shown is None else row_hash([shown(v) if c == text_col else v for c, v in values.items()])
    doc_id = F.col(id_col).cast("bigint")
    leaves = cut(docs.select(  # a null group sorts before all names
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("tree"), doc_id.alias("doc"),
        F.unhex(leaf).alias("hash"),
        F.concat(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), F.unhex(other)).alias("carried")), "leaves")
    ordered, sizes = numbered(leaves, [F.col("doc").asc_nulls_first(), F.col("hash").asc()], leaves.count(), "ordered")
    sizes = cut(sizes, "sizes")
    rounds, subroots = grow(ordered.drop("doc"), sizes, sizes.agg(F.max("n")).first()[0] or 0, "groups", levels)
    subroots = cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash",
                                   F.col("tree").cast("binary").alias("carried")), "subroots")
    n_groups = subroots.count()
    named, top_size = numbered(subroots, [F.col("group").asc()], n_groups, "named")
    top_rounds, root = grow(named.drop("group"), top_size, n_groups, "top", levels)
    root = root.select("tree", F.col("hash").alias("root"), F.lit(b"").alias("shape"), F.lit(b"").alias("siblings"))
    tops = _extended(top_rounds, root).select(F.col("carried").cast("string").alias("tree"), F.col("hash").alias("subroot"), "root",
                                              "shape", "siblings")
    found = _extended(rounds, tops)
    return found.select("carried", "hash", "shape", "siblings", "subroot", "root").mapInArrow(_folded, _RESULT)
