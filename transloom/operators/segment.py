"""Segmentation and reassembly.

Splitting is a narrow ``posexplode`` (no shuffle). Reassembly is one grouping by the row
key: a group holds one request's parts, which were one cell of the input before, so no
group grows with the table.

The row key (``with_row_key``) is a 128-bit hash of all columns of a request. Requests without
an id, or with one id, stay apart by it; it is the same on every read of the row, so a retried
task groups as the first one did. Rows that are equal in every column share the key: their parts
are told once (``collect_set``, combined before the shuffle) and counted, and the one result
row is repeated as often as the request was asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import go_trim, paragraph_parts
from transloom.functions.tokens import chunk_array, generation_budget, words

SEGMENT_KEYS = ["source", "target", "model", "segment"]
ROW_KEY = ["_h1", "_h2"]


def with_row_key(requests: DataFrame) -> DataFrame:
    """Add the row key: two 64-bit hashes of all columns, NULL told from empty. The constant comes first, so that the
    two differ in their seed."""
    if set(ROW_KEY) <= set(requests.columns):
        return requests
    cells = [v for c in requests.columns for v in (F.col(c), F.col(c).isNull())]
    return requests.withColumns({"_h1": F.xxhash64(F.lit(1), *cells), "_h2": F.xxhash64(F.lit(2), *cells)})


def paragraphs(requests: DataFrame, keep=("source", "target", "model")) -> DataFrame:
    """Parts in order; newline runs are separators, everything else a segment.

    The untrimmed text is split: only the final result is trimmed.
    """
    cols = ["request_id", *ROW_KEY, *[c for c in keep if c in requests.columns]]
    parts = with_row_key(requests).select(*cols, F.posexplode(paragraph_parts("text")).alias("part_no", "part"))
    return parts.withColumn("is_sep", F.col("part").startswith("\n"))


def token_chunks(parts: DataFrame, size: int = K.CHUNK_TOKENS) -> DataFrame:
    """Whitespace tokens of each text part in chunks of ``size``; no tokens, no chunk."""
    segs = parts.where(~F.col("is_sep"))
    exploded = segs.select("request_id", "part_no",
                           F.posexplode(chunk_array(words("part"), size)).alias("chunk_no", "tokens"))
    return exploded.select(
        "request_id", "part_no", "chunk_no",
        F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("chunk"),
    )


def token_budget(chunks: DataFrame) -> DataFrame:
    """source token count (pseudo tokenizer has no special ids) and generation cap."""
    n = F.greatest(F.lit(1), F.least(F.col("n_tokens"), F.lit(K.MODEL_INPUT_CAP)))
    return chunks.select("request_id", "part_no", "chunk_no", n.alias("source_tokens"),
                         generation_budget(n).alias("max_new_tokens"))


def unique_segments(parts: DataFrame) -> DataFrame:
    """One row per distinct (source, target, model, segment).

    ``distinct`` aggregates partially before its shuffle, so a segment that
    recurs in a third of all rows collapses map-side to one row per task.
    """
    return parts.where(~F.col("is_sep")).select(F.col("source"), F.col("target"), F.col("model"),
                                                F.col("part").alias("segment")).distinct()


def join_keys(parts: DataFrame) -> DataFrame:
    """Parts with the ``segment`` by which they are joined to their translation. A separator's key is its row's own: no
    segment holds a line end, so it matches nothing, and the separators spread over all partitions instead of
    meeting at one NULL key."""
    own = F.concat(F.lit("\n"), F.hex("_h1"), F.lit(":"), F.col("part_no"))
    return parts.withColumn("segment", F.when(F.col("is_sep"), own).otherwise(F.col("part")))


def fan_out(parts: DataFrame, translated: DataFrame, carry: tuple = ()) -> DataFrame:
    """Every part gets its translation by one left join; separators pass through. A segment without a
    translation is an error row.

    Hot segments make the part side skewed; AQE's skew-join split handles it (the translated side holds one row per key).
    """
    segs = join_keys(parts).select("request_id", *ROW_KEY, "source", "target", "model", "part_no", "is_sep", *carry,
                                   F.when(F.col("is_sep"), F.col("part")).alias("ready"), "segment")
    joined = segs.join(translated, SEGMENT_KEYS, "left")
    found = F.coalesce(F.col("translation").isNotNull() & (F.col("error") == ""), F.lit(False))
    lost = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).otherwise(F.lit(K.MSG_MISSING_TRANSLATION))
    return joined.select(
        "request_id", *ROW_KEY, "model", "part_no",
        F.when(F.col("is_sep"), F.col("ready")).when(found, F.col("translation")).otherwise(F.lit("")).alias("out"),
        F.when(~F.col("is_sep") & ~found, lost).otherwise(F.lit("")).alias("error"), *carry)


def reassemble(translated_parts: DataFrame, carry: tuple = ()) -> DataFrame:
    """Parts concatenated in order, then trimmed; any failed part fails the request. One row per row key;
    ``copies`` says how many equal requests it answers (``repeated`` gives each its row). ``carry`` names per-request
    columns that ride along."""
    rides = ("request_id", "model", *carry)
    g = translated_parts.groupBy(*ROW_KEY).agg(
        F.array_sort(F.collect_set(F.struct("part_no", "out", "error"))).alias("parts"),
        F.count_if(F.col("part_no") == 0).alias("copies"), *[F.any_value(c).alias(c) for c in rides])
    errors = F.filter("parts", lambda p: p["error"] != "")
    return g.select(
        *rides, *ROW_KEY, "copies",
        F.when(F.size(errors) > 0, F.lit("")).otherwise(
            go_trim(F.array_join(F.transform("parts", lambda p: p["out"]), ""))).alias("text"),
        F.coalesce(F.try_element_at(errors, F.lit(1))["error"], F.lit("")).alias("error"),
    )


def repeated(results: DataFrame) -> DataFrame:
    """One row for each of the equal requests that a result answers."""
    columns = [c for c in results.columns if c not in ("copies", *ROW_KEY)]
    return results.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).drop("_copy")
