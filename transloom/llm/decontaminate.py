"""Benchmark decontamination: containment search for short test items inside long documents.

DataFrame functions only. A test item is the set of its word shingles; it is found in a document that holds at
least ``min_containment`` of them, wherever they stand. MinHash signatures of equal length can't find an item of 30
shingles in a document of 20,000 (their Jaccard similarity is 0.002), so the search is asymmetric: items are
partitioned by size, and each partition has its own signature length k. An item's signature is its k smallest
shingle hashes. In the partition of sizes up to Q, k is
``floor((1 - min_containment) * Q) + 1``: a document that lacks at most that share of the item misses at most k - 1 of
its shingles, so it holds at least one of the signature's. Candidates are the documents that hold any signature
hash; a candidate is verified by counting shared shingles as text. Recall is therefore exact.

Documents' shingle hashes are made and probed where the rows are read; only candidates move. Signatures and shingles are
broadcast while their measured bytes are at most ``MAX_BYTES``, each on its own; beyond that the join is a shuffle.

Edge cases: a text with fewer words than a shingle has its whole word sequence as the one shingle; an item that short is
found wherever a document has this sequence, since documents are probed with each such length that occurs
among the items (four at most); null, empty and
blank texts have none and are never found or contaminated; items with equal words are one item, named by the
smallest item_id; rows with equal doc_id and item are one row, with the largest count; null doc_id is kept as null;
empty tables give no pairs; other columns are ignored by ``contained_items`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import cut, lower_ascii, words

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: Bytes up to which a table is broadcast.
MAX_BYTES = 16 << 20


def _windows(word: Column, n: int, of) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(word) - (n - 1)), lambda i: of(F.slice(word, i, F.lit(n))))


def _shingled(w: str, n: int, of, short: list[int]) -> Column:
    """Array of ``of(words of the shingle)`` for a column of words; besides the shingles of ``n`` words those of the
    lengths in ``short``."""
    word = F.col(w)
    own = F.when(F.size(word) >= n, _windows(word, n, of)).when(F.size(word) > 0, F.array(of(word)))
    return F.concat(own, *[F.when(F.size(word) >= m, _windows(word, m, of)).otherwise(F.slice(own, 1, 0)) for m in short]) if short else own


def shingle_hashes(w: str, n: int, short: list[int] = []) -> Column:  # noqa: B006
    return _shingled(w, n, lambda s: F.xxhash64(s), short)


def shingle_texts(w: str, n: int, short: list[int] = []) -> Column:  # noqa: B006
    return _shingled(w, n, lambda s: F.concat_ws(" ", s), short)


def _items(benchmark: DataFrame, item_col: str, item_text: str, n: int) -> DataFrame:
    """(item_id, shingles): one row for each different sequence of words."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words(lower_ascii(F.col(item_text))).alias("w"))
    one = rows.where(F.size("w") > 0).groupBy("w").agg(F.min("item_id").alias("item_id"))
    return one.select("item_id", F.array_distinct(shingle_texts("w", n)).alias("shingles"))


def signatures(items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(item_id, h): each item's signature; its length follows from the item's size partition (powers of two)."""
    rows = items.select("item_id", F.size("shingles").alias("q"), F.explode("shingles").alias("s"))
    rows = rows.select("item_id", "q", F.xxhash64(F.split("s", " ", -1)).alias("h"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("q")))
    k = F.floor(F.lit(1.0 - min_containment + 1e-9) * upper) + 1
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    return ranked.where(F.col("rank") <= k).select("item_id", "h")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` to be broadcast if it measures at most ``MAX_BYTES``."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= MAX_BYTES else df


def contained_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, rid, item_id, n_shingles, n_shared, containment) of each contained item; rid is a hash of the text."""
    items = cut(_items(benchmark, item_col, item_text, shingle_words), "items")
    n_words = F.size(F.split(F.col("shingles")[0], " ", -1))
    short = sorted(r[0] for r in items.select(n_words.alias("n")).where(F.col("n") < shingle_words).distinct().collect())
    signed = cut(signatures(items, min_containment), "signatures")
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("rid"),
                         words(lower_ascii(text)).alias("w"))
    probes = worded.select("doc_id", "rid", F.explode(shingle_hashes("w", shingle_words, short)).alias("h"))
    candidates = probes.join(_small(signed, F.lit(24)), "h").select("doc_id", "rid", "item_id").distinct()
    held = _small(items, F.aggregate("shingles", F.lit(0), lambda n, x: n + F.octet_length(x) + 16))
    asked = cut(candidates, "candidates").join(held, "item_id") \
        .withColumnsRenamed({"doc_id": "__doc", "rid": "__rid"})
    # texts are split again behind the join: a text moves more cheaply than its words
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("t"))
    found = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("rid") == F.col("__rid"))) \
        .withColumn("w", words(lower_ascii(F.col("t")))) \
        .withColumn("own", shingle_texts("w", shingle_words, short)) \
        .select("doc_id", "rid", "item_id", F.size("shingles").cast("bigint").alias("n_shingles"),
                F.size(F.array_intersect("own", "shingles")).cast("bigint").alias("n_shared"))
    # behind an aggregate: a filter on the count itself would be pushed down with the whole shingling copied into it
    one = found.groupBy("doc_id", "rid", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
    kept = one.where(F.col("n_shared") >= F.lit(min_containment) * F.col("n_shingles") - 1e-9)
    return kept.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per (doc_id, item_id)."""
    found = contained_items(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"),
                                                  F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    hit = cut(contained_items(docs, benchmark, id_col=id_col, text_col=text_col, **options)
              .select(F.col("doc_id").alias("__doc"), F.col("rid").alias("__rid")).distinct(), "contaminated")
    keyed = docs.withColumn("__r", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(hit, F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc")) & (F.col("__r") == F.col("__rid")), "left_anti") \
        .select(*docs.columns)
