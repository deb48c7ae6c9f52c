"""Line deduplication over the whole corpus.

Line keys become 128-bit hashes. The (hash, document, position) records are range-partitioned and sorted by
hash, then document from the largest id, then position; each partition is streamed once. The first document of
a hash keeps its lines, all others lose theirs, provided that the hash is found in enough documents. What comes
back is a compressed bitmap of kept lines for each document that loses any, not text.

Only a partition's first and last hash can go on in a neighbour. Their records are passed on undecided; the
counts and the largest document of these hashes (two at most for each partition, hence a proven bound) are summed
and broadcast. A line that a third of all documents share therefore spreads over as many partitions as its records
need, and no group is held in memory: a run keeps ``HELD`` records at most, and passes them on undecided beyond that.

Rows of one id and text are read once (``once_each``): a row repeated a million times costs one record a line.

Edge cases: a null or empty text is one empty line; a null id counts as smaller than any other and as one document;
rows that share an id count as one document, whose records of a line go to one task, and each row with its own text
gets its own bitmap; a line repeated in
one document counts once for it, and all its places go or stay together; an empty table gives no rows; other
columns are ignored by ``line_report`` and kept by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.llm.common import WHITE_CHARS, cut, lower_ascii, once_each, pieces, slices, text_bytes, width
from transloom.session import ship_package

MIN_CHARS = 40
MIN_DOCS = 5
#: Bytes of text for each range of line records.
RANGE_BYTES = 64 << 20
NO_ID = -(1 << 63)
#: Records of a run that wait for its count.
HELD = 100_000

_RECORD = ["h1", "h2", "doc", "rid", "pos"]
_OUT = "kind string, h1 bigint, h2 bigint, doc bigint, rid bigint, pos int, n_docs bigint"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE_CHARS)))


def line_records(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("rid"), text.alias("t"))
    lines = once_each(rows, ["doc", "rid"], "repeated").select("doc", "rid", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "rid", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # xxhash64 seeds each column's hash with the one before: the constant comes first, so that h2 is the key's under another seed
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "rid", "pos")


def _stream(batches: Iterable[pd.DataFrame], min_docs: int) -> Iterator[pd.DataFrame]:
    """Sorted records of one partition; emits dropped records, undecided records, and a note on the last hash. The largest
    document's records never go and are not held."""
    key, open_run, held = None, True, []
    n_docs, top, last_doc = 0, None, None
    for pdf in batches:
        out: list[tuple] = []
        for h1, h2, doc, rid, pos in zip(*(pdf[c].tolist() for c in _RECORD)):
            if (h1, h2) != key:
                open_run = key is None
                key, held, n_docs, top, last_doc = (h1, h2), [], 0, doc, None
            new = doc != last_doc
            n_docs, last_doc = n_docs + new, doc
            if open_run:
                out.append(("open", h1, h2, doc, rid, pos, int(new)))
            elif n_docs < min_docs:
                if doc != top or new:  # one record of the largest document tells that it is there
                    held.append((doc, rid, pos, int(new)))
                if len(held) > HELD:
                    out.extend(("open", h1, h2, *x) for x in held)
                    held, open_run = [], True
            else:
                out.extend(("drop", h1, h2, d, r, p, 0) for d, r, p, _ in held if d != top)
                held = []
                if doc != top:
                    out.append(("drop", h1, h2, doc, rid, pos, 0))
        if out:
            yield pd.DataFrame(out, columns=["kind", *_RECORD, "n_docs"])
    if key is not None and not open_run:
        rest = [("open", *key, d, r, p, new) for d, r, p, new in held] if n_docs < min_docs else \
            [("note", *key, top, 0, 0, n_docs)]
        yield pd.DataFrame(rest, columns=["kind", *_RECORD, "n_docs"])


def dropped_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                    min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, rid, pos) of each line that goes."""
    spark = docs.sparkSession
    ship_package(spark)
    n = width(spark, pieces(text_bytes(docs, text_col), RANGE_BYTES))
    # written first: the range partitioner reads its input twice, and texts should be split once
    records = cut(line_records(docs, id_col, text_col, min_chars), "records")
    dealt = records.repartitionByRange(n, "h1", "h2", F.desc("doc"))
    ordered = dealt.sortWithinPartitions("h1", "h2", F.desc("doc"), "rid", "pos")
    streamed = cut(ordered.mapInPandas(lambda it: _stream(it, min_docs), _OUT), "lines")
    at_edges = streamed.where(F.col("kind") != "drop")
    verdict = at_edges.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_all"), F.max("doc").alias("top")) \
        .where(F.col("n_all") >= min_docs)  # two hashes for each partition, and one for HELD records at most
    resolved = at_edges.where(F.col("kind") == "open").join(F.broadcast(verdict), ["h1", "h2"]) \
        .where(F.col("doc") != F.col("top"))
    return streamed.where(F.col("kind") == "drop").select("doc", "rid", "pos").unionByName(
        resolved.select("doc", "rid", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def one(places: np.ndarray) -> bytes:
        keep = np.ones((int(max(places)) // 8 + 1) * 8, np.uint8)
        keep[np.asarray(places)] = 0
        return zlib.compress(np.packbits(keep).tobytes())
    return dropped.map(one)


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc, rid, n_dropped, keep): for documents that lose lines, a zlib-compressed bitmap, most significant bit
    first, of the lines up to the byte of the last one that goes (bit set: the line stays). Lines after it stay."""
    gone = dropped_records(docs, **options).groupBy("doc", "rid").agg(F.collect_set("pos").alias("places"))
    return gone.select("doc", "rid", F.size("places").cast("bigint").alias("n_dropped"), _bitmap("places").alias("keep"))


def _kept(text: str | None, keep: bytes | None) -> tuple[str, int]:
    """(text without the lines that go, lines before)."""
    text = text or ""
    if keep is None:
        return text, text.count("\n") + 1
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    stays = bits[:len(lines)] + [1] * (len(lines) - len(bits))
    return "\n".join(x for x, s in zip(lines, stays) if s), len(lines)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options).withColumnsRenamed(
        {"doc": "__doc", "rid": "__rid", "n_dropped": "__n_dropped", "keep": "__keep"})
    keyed = docs.withColumns({"__d": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)),
                              "__r": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return keyed.join(maps, (F.col("__d") == F.col("__doc")) & (F.col("__r") == F.col("__rid")), "left")


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: lines before, lines that go, SHA-256 of what stays."""
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [_kept(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in kept], pa.int64()), batch.column(2),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in kept], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    joined = _with_bitmaps(rows, "doc_id", "text", options)
    return joined.select("doc_id", "text", F.coalesce("__n_dropped", F.lit(0)).cast("bigint").alias("n"), "__keep") \
        .mapInArrow(digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without the lines that go. Texts that lose nothing stay as they are."""
    ship_package(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns[:-1])
            cols[at] = pa.array([t if k is None else _kept(t, k)[0]
                                 for t, k in zip(cols[at].to_pylist(), batch.column(len(names)).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return _with_bitmaps(docs, id_col, text_col, options).select(*names, "__keep").mapInArrow(apply, schema)
